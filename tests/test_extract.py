"""Service day bounds, time-zone conversion, sampling, enrichment fan-out, day-table sink."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from faretrail.operators import (
    fares_for_day, make_human_readable, sample_card_ids, sample_user_transactions, write_day_table,
)
from faretrail.schema import RAW_SCHEMA


def _raw(spark, rows):
    """Raw transactions from (generationtime, serial, seq) triples."""
    data = []
    for g, serial, seq in rows:
        rec = {f.name: None for f in RAW_SCHEMA.fields}
        rec.update(generationtime=g, applicationserialnumber=serial, sequencenumber=seq, operatorid=1,
                   subtype=1, purseamount=1.0, originlocation="3", destinationlocation="x")
        data.append(tuple(rec[f.name] for f in RAW_SCHEMA.fields))
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_half_open_day_and_serial_cap(spark):
    d = dt.datetime
    raw = _raw(spark, [
        (d(2016, 4, 25, 10, 0, 0), 1, 0),          # exactly at the start: in (half-open)
        (d(2016, 4, 26, 9, 59, 59), 2, 1),          # in
        (d(2016, 4, 26, 10, 0, 0), 3, 2),           # next day's start: out
        (d(2016, 4, 25, 9, 59, 59), 4, 3),          # previous day: out
        (d(2016, 4, 25, 12, 0, 0), 2000000000, 4),  # serial at the cap: out
    ])
    got = sorted(r["sequencenumber"] for r in fares_for_day(raw, "2016-04-25").collect())
    assert got == [0, 1]
    strict = sorted(r["sequencenumber"] for r in fares_for_day(raw, "2016-04-25", strict=True).collect())
    assert strict == [1]


def test_zone_conversion_follows_dst(spark):
    d = dt.datetime
    raw = _raw(spark, [(d(2016, 7, 4, 17, 0, 0), 1, 0)])
    summer = fares_for_day(raw, "2016-07-04").collect()[0]
    assert summer["transaction_time"] == d(2016, 7, 4, 10, 0, 0)       # UTC-7
    raw = _raw(spark, [(d(2016, 1, 4, 17, 0, 0), 1, 0)])
    winter = fares_for_day(raw, "2016-01-04").collect()[0]
    assert winter["transaction_time"] == d(2016, 1, 4, 9, 0, 0)        # UTC-8
    assert "applicationserialnumber" not in fares_for_day(raw, "2016-01-04").columns
    assert len(summer["cardid_anony"]) == 40


def test_sampling_exact_n_and_deterministic(spark):
    d = dt.datetime(2016, 4, 25, 12)
    raw = _raw(spark, [(d + dt.timedelta(minutes=i), i % 7, i) for i in range(70)])
    day = fares_for_day(raw, "2016-04-25")
    ids1 = sorted(r[0] for r in sample_card_ids(day, 3, seed=1).collect())
    ids2 = sorted(r[0] for r in sample_card_ids(day, 3, seed=1).collect())
    assert len(ids1) == 3 and ids1 == ids2
    taps = sample_user_transactions(day, 3, seed=1)
    assert taps.select("cardid_anony").distinct().count() == 3
    assert taps.count() == 30
    with pytest.raises(Exception, match="cannot sample 8 cards"):
        sample_user_transactions(day, 8).collect()


def test_enrichment_fan_out_and_casts(spark):
    d = dt.datetime(2016, 4, 25, 12)
    raw = _raw(spark, [(d, 1, 0)])
    day = fares_for_day(raw, "2016-04-25")
    parts = spark.createDataFrame([(1, "A"), (1, "A-dup")], "participantid int, participantname string")
    routes = spark.createDataFrame([], "routeid int, participantid int, routename string")
    locs = spark.createDataFrame([(3, 1, "Main St")], "locationcode int, participantid int, locationname string")
    out = make_human_readable(day, parts, routes, locs).collect()
    assert sorted(r["participantname"] for r in out) == ["A", "A-dup"]     # visible fan-out
    assert {r["locationname_origin"] for r in out} == {"Main St"}
    assert {r["destinationlocation"] for r in out} == {None}                 # "x" is not a code


def test_write_day_table_overwrites_one_day(spark):
    d = dt.datetime
    raw = _raw(spark, [(d(2016, 4, 25, 12), 1, 0), (d(2016, 4, 26, 12), 2, 1)])
    path = os.path.join(tempfile.mkdtemp(prefix="faretrail-sink-"), "days")
    write_day_table(fares_for_day(raw, "2016-04-25"), path, "2016-04-25")
    write_day_table(fares_for_day(raw, "2016-04-26"), path, "2016-04-26")
    write_day_table(fares_for_day(raw, "2016-04-26"), path, "2016-04-26")
    back = spark.read.parquet(path)
    assert back.count() == 2
    assert sorted(r[0].isoformat() for r in back.select("service_date").distinct().collect()) == [
        "2016-04-25", "2016-04-26"]
    assert back.where(F.col("service_date") == "2016-04-26").count() == 1


def test_local_boundary_follows_dst():
    from faretrail.operators import day_bounds
    assert day_bounds("2016-01-04", "03:00:00", "local") == ("2016-01-04 11:00:00", "2016-01-05 11:00:00")
    assert day_bounds("2016-07-04", "03:00:00", "local") == ("2016-07-04 10:00:00", "2016-07-05 10:00:00")
    # spring-forward day is 23 hours long
    assert day_bounds("2016-03-13", "03:00:00", "local") == ("2016-03-13 10:00:00", "2016-03-14 10:00:00")
    assert day_bounds("2016-03-12", "03:00:00", "local") == ("2016-03-12 11:00:00", "2016-03-13 10:00:00")
    assert day_bounds("2016-03-12") == ("2016-03-12 10:00:00", "2016-03-13 10:00:00")


def test_write_transfer_database_replaces_months(spark):
    from faretrail.operators import write_transfer_database
    path = os.path.join(tempfile.mkdtemp(prefix="faretrail-db-"), "db")
    db = spark.createDataFrame([(2014, 3, 1), (2014, 4, 2)], "Year int, Month int, estimated_transfers int")
    write_transfer_database(db, path)
    write_transfer_database(spark.createDataFrame([(2014, 4, 9)], "Year int, Month int, estimated_transfers int"),
                            path)
    got = sorted((r["Month"], r["estimated_transfers"]) for r in spark.read.parquet(path).collect())
    assert got == [(3, 1), (4, 9)]


def test_bucketed_day_table_needs_no_exchange(spark):
    from faretrail import sources
    from faretrail.operators import as_rides, save_day_table

    raw = sources.raw_transactions(sources.read_table(spark, "/root/testdata/sf0.001", "events"))
    path = os.path.join(tempfile.mkdtemp(prefix="faretrail-bucketed-"), "days")
    table = "faretrail_days_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    for day in ("2024-01-03", "2024-01-04", "2024-01-04"):   # the repeat replaces the day
        save_day_table(fares_for_day(raw, day), table, path, day, buckets=4)
    days = spark.table(table)
    assert days.count() == fares_for_day(raw, "2024-01-03").count() + fares_for_day(raw, "2024-01-04").count()
    rides = as_rides(days)
    plan = rides._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    cols = ["cardid_anony", "sequencenumber", "tagon_time", "trip_cost"]
    want = as_rides(fares_for_day(raw, "2024-01-03").unionByName(fares_for_day(raw, "2024-01-04")))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, rides.select(*cols).collect()), key=key) == sorted(
        map(tuple, want.select(*cols).collect()), key=key)


def test_product_description_columns(spark):
    from faretrail import sources
    from faretrail.operators import get_product_description

    taps = sources.taps(spark, "/root/testdata/sf0.001")
    cmap, prods = (sources.contract_product_map(spark, "/root/testdata/sf0.001"),
                   sources.products(spark, "/root/testdata/sf0.001"))
    plain = get_product_description(taps, cmap, prods)
    kept = get_product_description(taps, cmap, prods, keep_category=True)
    assert "productcategory" not in plain.columns and "productcategory" in kept.columns
    assert plain.count() == taps.count()                       # unique product keys: no fan-out
    # every nation has products: nation 7 is no longer left out of the lookup
    assert plain.where("operatorid = 7").where("product_description is not null").count() > 0


def test_day_filter_prunes_service_date_partitions(spark):
    from pyspark.sql import functions as F

    from faretrail.session import checkpoint_dir

    path = checkpoint_dir(spark) + "/raw_by_date"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from faretrail import sources as src
    raw = src.raw_transactions(events)
    raw.withColumn("service_date", F.to_date("generationtime")).write.partitionBy("service_date").parquet(path)
    stored = spark.read.parquet(path)
    pruned, whole = fares_for_day(stored, "2024-01-10"), fares_for_day(raw, "2024-01-10")
    assert "PartitionFilters: [(isnull(service_date" in pruned._jdf.queryExecution().toString()
    assert sorted(pruned.select("sequencenumber").collect()) == sorted(whole.select("sequencenumber").collect())
