"""Travel sequences and the report aggregations."""

import datetime as dt

import pytest

from conftest import make_taps

from faretrail.operators import as_rides, extract_sequence_by_date, extract_sequence_for_random_week
from faretrail.plans import reports


def test_sequence_na_and_not_truncated(spark):
    rows = [{"minutes": i * 5, "locationname_destination": None if i == 0 else "B"} for i in range(60)]
    rows += [{"cardid_anony": "card-b", "minutes": i * 5, "locationname_destination": None if i == 0 else "B"}
             for i in range(60)]
    seqs = extract_sequence_by_date(as_rides(make_taps(spark, rows))).collect()
    assert len(seqs) == 1 and seqs[0]["n"] == 2
    recs = seqs[0]["RunSequence"].split(" ")
    assert len(recs) == 60 * 3
    assert recs[:3] == ["8", "A", "NA"] and recs[3:6] == ["8", "A", "B"]
    assert seqs[0]["CircadianDayOfWeek"] == "Wednesday"


def test_day_id_packing_and_decoding(spark):
    rows = [{"minutes": 0}, {"minutes": 60 * 18}]  # 08:00 and 02:00 next day: same circadian day
    out = extract_sequence_for_random_week(as_rides(make_taps(spark, rows))).collect()
    assert len(out) == 1
    r = out[0]
    assert r["DayID"] == 2024 * 1000000 + 1 * 10000 + 4 * 100 + 2
    assert (r["Year"], r["Month"], r["CircadianDayOfWeek"], r["RandomWeekID"]) == (2024, "January", "Wednesday", 2)
    assert r["RunSequence"] == "8 A B 2 A B"


def test_product_usage_weighting(spark):
    rides = spark.createDataFrame(
        [("c1", "P"), ("c1", "P"), ("c1", "P"), ("c2", "P"), ("c3", "Q")],
        "cardid_anony string, product_description string")
    ride = {r["product_description"]: r["mean_rides"] for r in reports.product_usage(rides, None).collect()}
    card = {r["product_description"]: r["mean_rides"]
            for r in reports.product_usage(rides, None, weighting="card").collect()}
    assert ride["P"] == (9 + 1) / 4 and card["P"] == 2.0 and ride["Q"] == 1.0
    top = reports.product_usage(rides, 1).collect()
    assert [r["product_description"] for r in top] == ["P"]


def _db(spark, rows):
    return spark.createDataFrame(rows, (
        "Year int, Month int, CircadianDayOfWeek int, RandomWeekID int, to_AgencyName string, "
        "from_AgencyName string, sampled_transfers long, from_Agency_Sampled_Transactions long, "
        "to_Agency_Sampled_Transactions long, estimated_transfers long, "
        "estimated_from_agency_transactions long, estimated_to_agency_transactions long"))


def test_shares_zero_denominator_and_labels(spark):
    db = _db(spark, [(2014, 3, 3, 6, "B", "A", 1, 0, 2, 2, 0, 4), (2014, 13, 4, 7, "B", "A", 1, 1, 1, 2, 2, 2)])
    s = sorted(reports.transfer_shares(db).collect(), key=lambda r: r["Month"])
    assert s[0]["from_share"] is None and s[0]["to_share"] == 0.5
    assert s[0]["MonthName"] == "March" and s[0]["DayName"] == "Tuesday"
    assert s[1]["MonthName"] == "ERROR" and s[1]["DayName"] == "Wednesday"


def test_totals_median_and_stddev(spark):
    db = _db(spark, [
        (2013, 3, 3, 6, "B", "A", 1, 1, 1, 2, 2, 2),
        (2013, 3, 4, 6, "B", "A", 2, 1, 1, 4, 2, 2),
        (2014, 3, 3, 6, "B", "A", 5, 1, 1, 10, 2, 2),
    ])
    out = {(r["Year"], r["is_total"]): r for r in reports.transfers_with_totals(db).collect()}
    assert out[(2013, False)]["median_transfers"] == 3.0
    assert abs(out[(2013, False)]["sd_transfers"] - 2 ** 0.5) < 1e-12
    assert out[(2014, False)]["sd_transfers"] is None
    assert out[(None, True)]["median_transfers"] == 4.0
    import statistics
    assert abs(out[(None, True)]["sd_transfers"] - statistics.stdev([2, 4, 10])) < 1e-12
    assert {r["observed_weeks"] for r in reports.observed_days(db).collect()} == {1}


def test_hour_histogram_skips_nulls(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7, 5),), (None,), (dt.datetime(2024, 1, 1, 7, 50),)],
                               "t timestamp_ntz")
    h = reports.hour_histogram(df, "t", "x").collect()
    assert [(r["hour"], r["n"]) for r in h] == [(7, 2)]


def test_wide_reports_keep_every_row_or_fail(spark):
    rows = [("a", 1, 2023, 5.0, 1), ("a", 1, 2024, 6.0, None), ("b", 2, 2024, None, 3), (None, 2, 2023, 7.0, 4)]
    long = spark.createDataFrame(rows, "name string, month int, year int, x double, n int")
    wide = reports.pivoted(long, "year", ["x", "n"], [2024, 2023])
    assert wide.columns == ["name", "month", "2024_x", "2024_n", "2023_x", "2023_n"]
    assert sorted(map(tuple, wide.collect()), key=str) == sorted([("a", 1, 6.0, None, 5.0, 1), ("b", 2, None, 3, None, None), (None, 2, None, None, 7.0, 4)], key=str)
    one = reports.pivoted(long.drop("n"), "year", ["x"])
    assert one.columns == ["name", "month", "2023", "2024"] and one.count() == 3
    assert reports.pivoted(long.limit(0), "year", ["x", "n"], [2023]).count() == 0
    for bad in (2022, None):
        more = long.union(spark.createDataFrame([("c", 1, bad, 1.0, 1)], long.schema))
        with pytest.raises(Exception, match="not among the headings of year"):
            reports.pivoted(more, "year", ["x", "n"], [2023, 2024]).collect()
