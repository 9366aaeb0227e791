"""Upkeep of the pair-day transfer database from the service days that changed.

The database is kept a service day apart: one partition of the sink holds the
pair rows of one day. A refresh recomputes the touched days from their whole
taps and replaces exactly their partitions, so appending days, sending days
again and replaying a batch all leave what a rebuild would. A day without
transfers is written as one marker row, so that rows of its earlier version do
not outlive it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faretrail.operators.enrich import make_human_readable
from faretrail.operators.ordering import CardOrder
from faretrail.operators.transfers import classify_rule_transfers
from faretrail.plans.reports import transfer_database
from faretrail.schema import CARD
from faretrail.streaming.daily import DAY


def day_transfer_database(days: DataFrame, lookups: tuple[DataFrame, DataFrame, DataFrame], rules: DataFrame,
                          sampling_rate: float = 0.5, segment_rows: int | None = 2_000_000) -> DataFrame:
    """The transfer database of a table of several service days, each card's days apart; with the day as a column."""
    order = CardOrder.settle(days.select(CARD, DAY), segment_rows, keys=(CARD, DAY))
    classified = classify_rule_transfers(make_human_readable(days, *lookups), rules, order)
    return transfer_database(classified, sampling_rate, by=(DAY,))


def refresh_transfer_database(spark: SparkSession, day_table: str, sink: str, touched: DataFrame,
                              lookups: tuple[DataFrame, DataFrame, DataFrame], rules: DataFrame, sampling_rate: float = 0.5,
                              segment_rows: int | None = 2_000_000) -> None:
    """Recompute the ``touched`` service days (a ``service_date`` column, repeats allowed) from ``day_table`` and replace them in ``sink``."""
    touched = touched.select(DAY).where(F.col(DAY).isNotNull()).distinct()
    days = spark.read.parquet(day_table).join(touched, DAY, "left_semi")
    rows = day_transfer_database(days, lookups, rules, sampling_rate, segment_rows)
    # one row at least for every touched day, also one that has no taps any more
    rows = touched.join(rows, DAY, "left")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(sink)


def read_transfer_database(spark: SparkSession, sink: str) -> DataFrame:
    """The pair rows of all days, markers left out."""
    return spark.read.parquet(sink).where(F.col("sampled_transfers").isNotNull()).withColumn(DAY, F.col(DAY).cast("date"))


def start_transfer_database(spark: SparkSession, day_table: str, sink: str, checkpoint_location: str,
                            lookups: tuple[DataFrame, DataFrame, DataFrame], rules: DataFrame, sampling_rate: float = 0.5,
                            available_now: bool = True, segment_rows: int | None = 2_000_000) -> StreamingQuery:
    """Keep ``sink`` in step with ``day_table``: files that land in it name the days to refresh."""
    changes = spark.readStream.schema(spark.read.parquet(day_table).schema).parquet(day_table)

    def refresh(batch: DataFrame, epoch_id: int) -> None:
        refresh_transfer_database(spark, day_table, sink, batch, lookups, rules, sampling_rate, segment_rows)

    writer = changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
