"""The streaming day-matrix equals the batch operator run per day, and only
touched days are rewritten."""

import os
import tempfile

from pyspark.sql import functions as F

from faretrail import sources
from faretrail.operators import create_transfer_df, fares_for_day, make_human_readable, write_day_table
from faretrail.streaming import read_daily_matrix, start_daily_transfer_matrix

from conftest import SF_SMALL


def _batch_matrix(spark, raw, dims, day):
    e = make_human_readable(fares_for_day(raw, day), *dims)
    return create_transfer_df(e, 120).withColumn("service_date", F.lit(day).cast("date"))


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.select(*cols).collect())


def test_daily_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="faretrail-stream-")
    table, sink, ckpt = (os.path.join(root, x) for x in ("days", "sink", "ckpt"))
    raw = sources.raw_transactions(sources.read_table(spark, SF_SMALL, "events"))
    dims = (sources.participants(spark, SF_SMALL), sources.routes(spark, SF_SMALL),
            sources.locations(spark, SF_SMALL))
    for day in ("2024-01-03", "2024-01-04"):
        write_day_table(fares_for_day(raw, day), table, day)
    start_daily_transfer_matrix(spark, table, sink, ckpt, *dims).awaitTermination()
    got = read_daily_matrix(spark, sink)
    want = _batch_matrix(spark, raw, dims, "2024-01-03").unionByName(_batch_matrix(spark, raw, dims, "2024-01-04"))
    assert _rows(got) == _rows(want)

    # a new day arrives: the next run adds it and leaves the others as they were
    write_day_table(fares_for_day(raw, "2024-01-05"), table, "2024-01-05")
    start_daily_transfer_matrix(spark, table, sink, ckpt, *dims).awaitTermination()
    got = read_daily_matrix(spark, sink)
    want = want.unionByName(_batch_matrix(spark, raw, dims, "2024-01-05"))
    assert _rows(got) == _rows(want)


def test_day_matrix_hot_split_equals_plain(spark):
    root = tempfile.mkdtemp(prefix="faretrail-stream-")
    table = os.path.join(root, "days")
    raw = sources.raw_transactions(sources.read_table(spark, SF_SMALL, "events"))
    dims = (sources.participants(spark, SF_SMALL), sources.routes(spark, SF_SMALL),
            sources.locations(spark, SF_SMALL))
    for day in ("2024-01-03", "2024-01-04"):
        write_day_table(fares_for_day(raw, day), table, day)
    days = spark.read.parquet(table)
    from faretrail.streaming import day_matrix
    assert _rows(day_matrix(days, *dims, segment_rows=5)) == _rows(day_matrix(days, *dims, segment_rows=None))


def test_replay_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="faretrail-stream-")
    table, sink = os.path.join(root, "days"), os.path.join(root, "sink")
    raw = sources.raw_transactions(sources.read_table(spark, SF_SMALL, "events"))
    dims = (sources.participants(spark, SF_SMALL), sources.routes(spark, SF_SMALL),
            sources.locations(spark, SF_SMALL))
    for day in ("2024-01-06", "2024-01-07"):
        write_day_table(fares_for_day(raw, day), table, day)
    start_daily_transfer_matrix(spark, table, sink, os.path.join(root, "ckpt1"), *dims).awaitTermination()
    first = _rows(read_daily_matrix(spark, sink))
    # a lost checkpoint replays every file: the same partitions are rewritten, nothing is doubled
    start_daily_transfer_matrix(spark, table, sink, os.path.join(root, "ckpt2"), *dims).awaitTermination()
    assert _rows(read_daily_matrix(spark, sink)) == first
