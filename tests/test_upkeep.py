"""Medians by counting, upkeep of the transfer database, day tables that are read by card."""

from __future__ import annotations

import glob
import random

import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL
from faretrail import sources as src
from faretrail.operators import exact_medians, save_day_table, taps_of_card, write_day_table
from faretrail.operators import medians
from faretrail.plans import catalog
from faretrail.streaming.transfer_db import (
    day_transfer_database, read_transfer_database, refresh_transfer_database, start_transfer_database,
)
from pyspark.sql import functions as F


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


# medians --------------------------------------------------------------------------
def test_medians_by_counting_are_medians(spark, monkeypatch):
    """Ties, even and odd groups, nulls, values over many magnitudes, infinities, NaN, null keys."""
    rng = random.Random(1)
    rows = [("few", 1, x) for x in (3.0, 1.0, 2.0)] + [("even", 1, x) for x in (1.0, 4.0)] + [("none", 1, None)] * 3 + [("one", 2, -7.5), ("one", 2, None)]
    rows += [("spread", None, rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(500)] + [(None, 3, rng.random()) for _ in range(301)]
    rows += [("ties", 1, float(rng.randrange(3))) for _ in range(400)] + [("odd", 1, x) for x in (float("inf"), float("-inf"), float("nan"), 1.0, 2.0)]
    rows += [("wide", 1, x) for x in (1.7e308, -1.7e308, 1.6e308, 5.0, 7.0)] + [("same", 9, 0.25)] * 300
    rows += [("edge", 1, x) for x in [float("inf")] * 4 + [2.0] * 5]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(4)
    want = _rows(df.groupBy("a", "b").agg(F.median("v").alias("median")))
    for below in (medians.FEW, 3):
        got = _rows(exact_medians(df, ["a", "b"], "v", bins_below=below))
        assert [r[:2] for r in got] == [r[:2] for r in want]
        for g, w in zip(got, want):
            assert str(g[2]) == str(w[2]) or g[2] == pytest.approx(w[2], rel=1e-15)
    monkeypatch.setattr(medians, "BROADCAST_RANGES", 0)
    assert [str(r) for r in _rows(exact_medians(df, ["a", "b"], "v"))] == [str(r) for r in got]
    assert exact_medians(df.limit(0), ["a"], "v").count() == 0


def test_no_task_holds_a_group(spark):
    """All rows in one group: after the first pass a task gets bins, not values, and at most the few it puts in order."""
    df = spark.range(300_000).selectExpr("1 AS a", "cast(id * 7919 % 300007 AS double) AS v")
    got = exact_medians(df, ["a"], "v", bins_below=100)
    assert got.collect()[0]["median"] == df.agg(F.median("v")).first()[0]


# transfer database ------------------------------------------------------------------
@pytest.fixture(scope="module")
def parts(spark):
    i = catalog.Inputs(spark, SF_SMALL, None)
    days = i.taps.withColumn("service_date", F.to_date(F.expr("transaction_time - INTERVAL 3 HOURS")))
    days = days.where("service_date < '2024-01-09'")
    return days, i.dims, src.transfer_rules_from(i.nation)


def test_replayed_days_equal_a_rebuild(spark, parts, tmp_path):
    days, lookups, rules = parts
    table, sink = str(tmp_path / "days"), str(tmp_path / "db")
    days.write.partitionBy("service_date").parquet(table)
    want = _rows(day_transfer_database(spark.read.parquet(table), lookups, rules))
    dates = spark.read.parquet(table).select("service_date").distinct()
    columns = day_transfer_database(spark.read.parquet(table), lookups, rules).columns
    for touched in (dates.where("day(service_date) < 4"), dates.where("day(service_date) > 2"), dates.union(dates)):
        refresh_transfer_database(spark, table, sink, touched, lookups, rules)
    assert want and _rows(read_transfer_database(spark, sink).select(columns)) == want
    # a day whose taps go loses its rows, the others stay; a day rewritten with other taps gets theirs
    gone = spark.sql("SELECT date'2024-01-05' AS service_date")
    days.where("service_date = '2024-01-05'").limit(0).select(*days.columns[:-1]).write.mode("overwrite").parquet(table + "/service_date=2024-01-05")
    refresh_transfer_database(spark, table, sink, gone, lookups, rules)
    rest = [r for r in want if str(r[columns.index("service_date")]) != "2024-01-05"]
    assert len(rest) < len(want) and _rows(read_transfer_database(spark, sink).select(columns)) == rest
    assert _rows(day_transfer_database(spark.read.parquet(table), lookups, rules, segment_rows=5)) == rest


def test_stream_keeps_the_database(spark, parts, tmp_path):
    days, lookups, rules = parts
    table, sink, state = (str(tmp_path / x) for x in ("days", "db", "state"))
    for part in ("day(service_date) <= 4", "day(service_date) > 4"):
        days.where(part).write.mode("append").partitionBy("service_date").parquet(table)
        start_transfer_database(spark, table, sink, state, lookups, rules).awaitTermination()
    want = day_transfer_database(spark.read.parquet(table), lookups, rules)
    assert _rows(read_transfer_database(spark, sink).select(want.columns)) == _rows(want)


# day tables -------------------------------------------------------------------------
def _day(spark):
    """6,000 taps of 300 cards, one of them hot."""
    ids = spark.range(6000)
    card = F.when(F.col("id") % 3 == 0, F.lit("5000")).otherwise((F.col("id") % 299).cast("string"))
    return ids.select(F.sha1(card).alias("cardid_anony"), (F.lit("2024-01-10 10:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id)")).alias("transaction_time"),
                      F.col("id").alias("sequencenumber"), F.repeat(F.col("id").cast("string"), F.lit(40)).alias("vehicleid"))


def _scanned(df) -> int:
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_a_card_lookup_reads_its_row_groups(spark, tmp_path):
    path = str(tmp_path / "days")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")   # so little data would be put into one file
    try:
        write_day_table(_day(spark), path, "2024-01-10", row_group_bytes=16 << 10)
    finally:
        spark.conf.set(merging, "true")
    groups = []
    for f in glob.glob(path + "/service_date=2024-01-10/*.parquet"):
        meta = pq.read_metadata(f)
        at = meta.schema.names.index("cardid_anony")
        groups += [(s.min, s.max, meta.row_group(k).num_rows) for k in range(meta.num_row_groups) if (s := meta.row_group(k).column(at).statistics)]
    assert len(groups) > 20
    days = spark.read.parquet(path)
    cold = taps_of_card(days, serial=7)
    assert cold.count() == _day(spark).where(F.col("cardid_anony") == F.sha1(F.lit("7"))).count() > 0
    card = cold.first().cardid_anony
    holding = [n for low, high, n in groups if low <= card <= high]
    assert len(holding) <= 2 and _scanned(cold) <= sum(holding) < 600
    # a card that is not there, between two that are: the Bloom filter (or dictionary) leaves nothing to read
    assert _scanned(taps_of_card(days, card="8" * 40)) == 0
    # the hot card spans several files
    hot = taps_of_card(days, serial=5000)
    assert hot.count() == 2000 and hot.select(F.input_file_name()).distinct().count() > 1
    with pytest.raises(ValueError):
        taps_of_card(days)


def test_hot_buckets_are_written_by_several_tasks(spark, tmp_path):
    table = "faretrail_hot_days"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    for _ in range(2):
        save_day_table(_day(spark), table, str(tmp_path / "t"), "2024-01-10", buckets=3, segment_rows=300)
    save_day_table(_day(spark).limit(10), table, str(tmp_path / "t"), "2024-01-11", buckets=3)
    days = spark.table(table)
    assert days.groupBy("service_date").count().orderBy("service_date").collect()[0]["count"] == 6000 and days.count() == 6010
    assert taps_of_card(days, serial=5000).select(F.input_file_name()).distinct().count() > 1
    from pyspark.sql import Window
    w = Window.partitionBy("cardid_anony").orderBy("transaction_time", "sequencenumber")
    ranked = days.where("service_date = '2024-01-10'").select("cardid_anony", "sequencenumber", F.lag("sequencenumber").over(w).alias("before"))
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    plain = _day(spark).select("cardid_anony", "sequencenumber", F.lag("sequencenumber").over(w).alias("before"))
    assert _rows(ranked) == _rows(plain)
    spark.sql(f"DROP TABLE {table}")
