"""Null cards in the split plan, several journey keys, wide totals, changed files."""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import make_taps
from faretrail.operators.focal import cards_using_operator
from faretrail.operators.journeys import add_journey_id
from faretrail.operators.ordering import CardOrder
from faretrail.plans import catalog, reports
from pyspark.sql import functions as F


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def null_taps(spark):
    cards = [None, "a", "b"]
    rows = [{"cardid_anony": cards[i % 3] if i % 5 else None, "minutes": 17 * i, "operatorid": 4 if i % 7 == 0 else 1, "subtype": 1}
            for i in range(40)]
    return make_taps(spark, rows)


def test_null_cards_are_the_same_in_the_split_plan(null_taps):
    split = CardOrder.detect(null_taps.select("cardid_anony", "transaction_time"), 4)
    assert _rows(cards_using_operator(null_taps, 4, order=split)) == _rows(cards_using_operator(null_taps, 4))
    cols = ["cardid_anony", "sequencenumber", "journey_id", "num_legs"]
    assert _rows(add_journey_id(null_taps, order=split).select(*cols)) == _rows(add_journey_id(null_taps).select(*cols))


def test_journeys_of_several_keys_are_dense_and_unique(null_taps):
    day = null_taps.withColumn("service_date", (F.lit(dt.date(2024, 1, 10))))
    day = day.withColumn("service_date", F.when(F.col("sequencenumber") % 2 == 0, F.date_add("service_date", 1)).otherwise(F.col("service_date")))
    out = add_journey_id(day, order=CardOrder.plain(("cardid_anony", "service_date"))).collect()
    owners = {}
    for r in out:
        owners.setdefault(r.journey_id, set()).add((r.cardid_anony, r.service_date))
    assert sorted(owners) == list(range(1, len(owners) + 1))
    assert all(len(v) == 1 for v in owners.values())


def test_totals_of_large_counts_do_not_overflow(spark):
    db = spark.range(1000).select(F.lit("a").alias("from_AgencyName"), F.lit("b").alias("to_AgencyName"), F.lit(2024).alias("Year"),
                                  (F.col("id") + 100_000_000).alias("estimated_transfers"))
    got = reports.transfers_with_totals(db).collect()
    assert [round(r.sd_transfers, 6) for r in got] == [round((1000 * 1001 / 12) ** 0.5, 6)] * 2


def test_appended_files_are_seen(spark, tmp_path):
    for t in ("events", "nation", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(100).write.parquet(str(tmp_path / f"{t}.parquet"))
    before = catalog.run("time_columns", spark, str(tmp_path)).count()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert catalog.run("time_columns", spark, str(tmp_path)).count() == before + 50
