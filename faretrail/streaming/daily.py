"""Incremental per-service-day transfer matrix with Structured Streaming.

Service-day tables land as ``service_date=`` partitions (see
``operators.extract.write_day_table``). The file stream over that folder is
used as a change feed: each micro-batch names the service days that received
files, ``foreachBatch`` re-reads those days *whole* from the table (partition
pruning through a semi-join on the partition column), recomputes their
operator-pair matrices with the batch operators, and overwrites exactly those
day partitions of the sink.

* exact: windows always see a complete card-day, however the files of a day
  were split across micro-batches;
* idempotent: a retried or replayed batch rewrites the same partitions with
  the same rows (dynamic partition overwrite), so restarts after executor or
  driver loss are safe; progress lives in ``checkpoint_location`` (shared
  storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faretrail.operators.enrich import make_human_readable
from faretrail.operators.ordering import CardOrder
from faretrail.operators.transfers import create_transfer_df
from faretrail.schema import CARD

DAY = "service_date"


def day_matrix(days: DataFrame, participants: DataFrame, routes: DataFrame, locations: DataFrame,
               mins: float = 120, segment_rows: int | None = 2_000_000) -> DataFrame:
    """Operator-pair transfer matrix per service day of a multi-day tap table.

    Windows are keyed by (card, service day); a (card, day) with more than
    ``segment_rows`` taps is split exactly (see ``CardOrder``).
    """
    enriched = make_human_readable(days, participants, routes, locations)
    order = CardOrder.settle(days.select(CARD, DAY), segment_rows, keys=(CARD, DAY))
    return create_transfer_df(enriched, mins, order, by=(DAY,))


def start_daily_transfer_matrix(spark: SparkSession, day_table: str, sink: str, checkpoint_location: str,
                                participants: DataFrame, routes: DataFrame, locations: DataFrame,
                                mins: float = 120, available_now: bool = True,
                                segment_rows: int | None = 2_000_000) -> StreamingQuery:
    """Keep ``sink`` (parquet, partitioned by service day) in step with ``day_table``."""
    schema = spark.read.parquet(day_table).schema
    changes = spark.readStream.schema(schema).parquet(day_table)

    def refresh(batch: DataFrame, epoch_id: int) -> None:
        touched = batch.select(DAY).distinct()
        whole_days = spark.read.parquet(day_table).join(touched, DAY, "left_semi")
        out = day_matrix(whole_days, participants, routes, locations, mins, segment_rows)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(DAY).parquet(sink))

    writer = changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_daily_matrix(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).withColumn(DAY, F.col(DAY).cast("date"))
