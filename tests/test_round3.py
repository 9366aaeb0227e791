"""Bursts of hot cards, given trip sequences, rewritten files, lookups by name, listed files, samples of days."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from conftest import SF_SMALL, make_taps
from faretrail import sources
from faretrail.operators import (
    add_journey_id, as_focal_journeys, as_rides, descriptive_tables, extract_sequence_by_date, merge_samples,
    sample_card_ids, sample_user_transactions, sequences_of_sampled_trips, write_sample_state,
)
from faretrail.operators.ordering import SEGMENT, CardOrder
from faretrail.plans import catalog
from pyspark.sql import functions as F

AT = dt.datetime(2024, 1, 10, 8)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


# bursts ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def burst(spark):
    """Most taps of a card (and of null cards) at one instant, told apart by their sequence numbers alone; a slow rest."""
    rows = []
    for i in range(900):
        card = ["hot", None, "cold-a", "cold-b"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2 + i % 2]
        rows.append({"cardid_anony": card, "transaction_time": AT + (dt.timedelta(minutes=i) if i % 50 == 0 else dt.timedelta(0)),
                     "operatorid": 4 if i % 3 else 1, "subtype": [4, 5, 1, 2, 3][i % 5], "sequencenumber": (i * 7) % 900})
    return make_taps(spark, rows).repartition(3)


@pytest.mark.parametrize("rows", [20, 97])
def test_segments_of_a_burst_are_bounded_and_in_order(burst, rows):
    order = CardOrder.settle(burst, rows)
    got = order._segmented(burst).select("cardid_anony", SEGMENT, "transaction_time", "sequencenumber").collect()
    assert len(got) == 900
    sizes, last = {}, {}
    for r in sorted(got, key=lambda r: (str(r.cardid_anony), r.transaction_time, r.sequencenumber)):
        sizes[r.cardid_anony, r[SEGMENT]] = sizes.get((r.cardid_anony, r[SEGMENT]), 0) + 1
        assert r[SEGMENT] >= last.get(r.cardid_anony, 0)
        last[r.cardid_anony] = r[SEGMENT]
    hot = [n for (c, _), n in sizes.items() if c in ("hot", None)]
    assert max(hot) <= rows and len(hot) >= 810 // rows


@pytest.mark.parametrize("rows", [20, 97])
def test_bursts_give_the_plain_results(burst, rows):
    order = CardOrder.settle(burst, rows)
    for op in (as_rides, lambda d, order=None: as_focal_journeys(d, order=order), add_journey_id_of, extract_of):
        assert _rows(op(burst, order=order)) == _rows(op(burst))


def add_journey_id_of(d, order=None):
    return add_journey_id(d, 30, order).select("cardid_anony", "sequencenumber", "journey_id", "num_legs")


def extract_of(d, order=None):
    return extract_sequence_by_date(as_rides(d, order), order)


def test_a_second_of_many_taps_is_no_single_task(spark):
    """200,000 taps of one card in one second: ranges and segments both stay below twice their size."""
    taps = spark.range(200_000).select(F.lit("hot").alias("cardid_anony"), F.lit(AT).cast("timestamp_ntz").alias("transaction_time"),
                                       F.col("id").alias("sequencenumber"), F.lit(4).alias("operatorid"), F.lit(1).alias("subtype"), F.lit(1.0).alias("purseamount"))
    order = CardOrder.settle(taps, 10_000)
    cut = order._segmented(taps)
    assert cut.groupBy(SEGMENT).count().agg(F.max("count")).first()[0] <= 10_000
    assert cut.where(F.col(SEGMENT) > 0).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20_000


def test_no_hot_card_is_the_plain_plan(burst):
    assert CardOrder.settle(burst, 10_000).hot is None
    assert CardOrder.settle(burst, None).hot is None


# sequences ------------------------------------------------------------------------
def test_hot_days_are_joined_in_pieces(spark, burst, monkeypatch):
    from faretrail.operators import sequences
    monkeypatch.setattr(sequences, "PIECE", 7)
    order = CardOrder.settle(burst, 50)
    rides = as_rides(burst, order)
    assert _rows(extract_sequence_by_date(rides, order)) == _rows(extract_sequence_by_date(as_rides(burst)))
    pieces = sequences.sequence_records(rides, order)
    assert pieces.where(F.col(SEGMENT) > 0).groupBy("CardID", SEGMENT).count().agg(F.max("count")).first()[0] <= 7


TRIPS = "ClipperCardID string, Year int, Month int, CircadianDayOfWeek int, RandomWeekID int, TripSequenceID long, TagOnTime_Time string, TagOnLocationName string, TagOffLocationName string"


def test_given_trip_order_decides(spark):
    rows = [("a", 2014, 3, 3, 7, 2, "08:05:00", "X", "Y"), ("a", 2014, 3, 3, 7, 1, "21:00:00", "Y", "X"), ("a", 2014, 3, 3, 7, None, "07:00:00", None, "Z"),
            ("b", 2014, 3, 3, 7, 5, "21:10:00", "Y", "X"), ("b", 2014, 3, 3, 7, 9, "08:00:00", "X", "Y"), ("b", 2014, 3, 3, 7, 10, "7am", "Q", None),
            ("b", 2014, 3, 3, 8, 1, "09:00:00", "X", "Y"), (None, 2014, 3, 3, 8, 1, "09:59:59", "X", "Y"), ("c", None, 3, 3, 8, 1, "09:00:00", "X", "Y")]
    trips = spark.createDataFrame(rows, TRIPS)
    want = [(2014030307, 2014, "March", "Tuesday", 7, "21 Y X 8 X Y 7 NA Z", 1), (2014030307, 2014, "March", "Tuesday", 7, "21 Y X 8 X Y NA Q NA", 1),
            (2014030308, 2014, "March", "Tuesday", 8, "9 X Y", 2), (None, None, None, None, None, "9 X Y", 1)]
    assert _rows(sequences_of_sampled_trips(trips)) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    split = CardOrder.settle(trips, 1, keys=("ClipperCardID",))
    assert split.hot is not None and _rows(sequences_of_sampled_trips(trips, split)) == _rows(sequences_of_sampled_trips(trips))
    assert sequences_of_sampled_trips(trips.limit(0)).count() == 0
    with pytest.raises(ValueError, match="TripSequenceID"):
        sequences_of_sampled_trips(trips.drop("TripSequenceID"))


def test_given_order_is_not_the_order_of_time(spark):
    given = {r.RunSequence for r in catalog.run("sequences_sampled_trips", spark, SF_SMALL).collect()}
    assert given - {r.RunSequence for r in catalog.run("sequences_by_date", spark, SF_SMALL).collect()}


# files ----------------------------------------------------------------------------
def test_rewritten_files_are_seen(spark, tmp_path):
    """The same name with other content gives the other rows, and another decision on hot cards."""
    import pyarrow.parquet as pq
    for t in ("events", "nation", "part"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{t}.parquet").slice(0, 100), tmp_path / f"{t}.parquet")
    assert catalog.run("time_columns", spark, str(tmp_path)).count() == 100
    assert catalog.run("rides", spark, str(tmp_path), 60).count() > 0
    pq.write_table(pq.read_table(f"{SF_SMALL}/events.parquet"), tmp_path / "events.parquet")
    whole = pq.read_metadata(f"{SF_SMALL}/events.parquet").num_rows
    assert catalog.run("time_columns", spark, str(tmp_path)).count() == whole
    assert _rows(catalog.run("rides", spark, str(tmp_path), 60)) == _rows(catalog.run("rides", spark, SF_SMALL))


def test_files_are_listed_without_their_content(spark, tmp_path):
    folder = tmp_path / "box"
    folder.mkdir()
    for name in ("2014 - 04 Transaction.csv", "2014 - 04 Transfer.csv", "2014 - 05 Transaction.csv", "2014 - 05 Transaction b.csv", "2014 - 05 Transfer.csv", "notes.txt", "_hidden"):
        (folder / name).write_text("x" * 10)
    spark.range(3).selectExpr("id", "'2014 - 06 Transfer: a.csv' AS file").write.partitionBy("file").csv(str(folder / "more"))
    listed = sources.list_files(spark, str(folder))
    read = re.search(r"ReadSchema: struct<([^>]*)>", listed._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "length" in read and "content" not in read
    names = {r.name: r.length for r in listed.collect()}
    assert names["2014 - 04 Transfer.csv"] == 10 and "2014 - 06 Transfer: a.csv" in names and "_hidden" not in names
    got = _rows(sources.file_manifest(listed))
    assert got == sorted([(2014, 4, "2014 - 04 Transaction.csv", "2014 - 04 Transfer.csv"), (2014, 5, "2014 - 05 Transaction b.csv", "2014 - 05 Transfer.csv"),
                          (2014, 5, "2014 - 05 Transaction.csv", None), (2014, 6, None, "2014 - 06 Transfer: a.csv")],
                         key=lambda r: tuple((v is None, str(v)) for v in r))


def test_lookups_by_name(spark, tmp_path):
    whole = {"operators": ("1L AS participantid", "'A' AS participantname", "7 AS extra"), "routes": ("1 AS routeid", "1 AS participantid", "'R' AS routename"),
             "locations": ("1 AS locationcode", "1 AS participantid", "'L' AS locationname")}
    for name, columns in whole.items():
        df = spark.range(2).selectExpr(*columns)
        df.write.parquet(str(tmp_path / (name + ".parquet" * (name == "routes"))))
        df.createOrReplaceTempView(name)
    for tables in (descriptive_tables(spark, str(tmp_path)), descriptive_tables(spark)):
        assert set(tables) == {"operators", "routes", "locations"} and all(t.count() == 2 for t in tables.values())
        assert dict(tables["operators"].dtypes) == {"participantid": "int", "participantname": "string", "extra": "int"}
    spark.range(1).selectExpr("'1' AS routeid", "1 AS participantid").createOrReplaceTempView("routes")
    with pytest.raises(ValueError, match=r"routes: routeid int \(string\), routename string \(missing\)"):
        descriptive_tables(spark)
    for name in whole:
        spark.catalog.dropTempView(name)
    with pytest.raises(ValueError, match="no table operators"):
        descriptive_tables(spark)
    with pytest.raises(ValueError, match="no table operators"):
        descriptive_tables(spark, str(tmp_path / "empty"))


def test_pair_days_survive_csv(spark, tmp_path):
    db = catalog.run("transfer_database", spark, SF_SMALL)
    sources.write_pair_day(db, str(tmp_path / "pairs"))
    back = sources.read_pair_day(spark, str(tmp_path / "pairs"))
    assert back.schema == sources.files.PAIR_DAY_SCHEMA
    assert _rows(back) == _rows(db.select(back.columns))


# samples --------------------------------------------------------------------------
def test_samples_of_days_merge(spark, tmp_path):
    days = spark.range(600).selectExpr("cast(id * 7 % 40 AS string) AS cardid_anony", "date_add(date'2024-01-01', cast(id % 13 AS int)) AS service_date")
    days = days.unionByName(spark.sql("SELECT cast(null AS string) AS cardid_anony, date'2024-01-01' AS service_date"))
    path = str(tmp_path / "states")
    for part in (days.where("service_date < '2024-01-06'"), days.where("service_date >= '2024-01-05'"), days.where("service_date = '2024-01-13'")):
        write_sample_state(part, path, 9, seed=3)   # days written twice are replaced
    states = spark.read.parquet(path)
    assert states.groupBy("service_date").count().agg(F.max("count")).first()[0] <= 9
    assert states.select("service_date").distinct().count() == 13
    for n in (1, 5, 9):
        assert _rows(merge_samples(states, n)) == _rows(sample_card_ids(days, n, seed=3, check=True))
    few = states.where("service_date = '2024-01-13'")
    assert _rows(merge_samples(few, 4)) == _rows(sample_card_ids(days.where("service_date = '2024-01-13'"), 4, seed=3))


def test_too_small_and_empty_populations_raise(spark):
    cards = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "cardid_anony string")
    assert sample_card_ids(cards, 2, check=True).count() == 2
    for df, found in ((cards, 2), (cards.limit(0), 0), (cards.where("cardid_anony IS NULL"), 0)):
        for n in (3, 5):
            with pytest.raises(Exception, match=f"cannot sample {n} cards from {found}"):
                sample_card_ids(df, n, check=True).collect()
            with pytest.raises(Exception, match=f"cannot sample {n} cards from {found}"):
                sample_user_transactions(df, n).collect()
    states = cards.selectExpr("cardid_anony", "'x' AS draw")
    with pytest.raises(Exception, match="cannot sample 2 cards from 0"):
        merge_samples(states.limit(0), 2).collect()
