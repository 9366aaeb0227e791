"""File sources: rule CSV, pair-day CSV, file manifest; driver-table mapping."""

import os
import tempfile

from faretrail import sources


def _write(text: str, name: str) -> str:
    d = tempfile.mkdtemp(prefix="faretrail-src-")
    p = os.path.join(d, name)
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_rules_csv_quotes_and_spaces(spark):
    path = _write(
        "from_AgencyName, to_AgencyName, max_time\n"
        "'City Bus','Rail',40\n"
        "'Rail','Golden Gate Ferry',60\n"
        "'Rail', 'Rail', 10\n", "rules.csv")
    rules = {(r[0], r[1]): r[2] for r in sources.read_transfer_rules(spark, path).collect()}
    assert rules == {("City Bus", "Rail"): 40, ("Rail", "Golden Gate Ferry"): 60, ("Rail", "Rail"): 10}


def test_pair_day_csv(spark):
    path = _write(
        "Year,Month,CircadianDayOfWeek,RandomWeekID,to_AgencyName,from_AgencyName,sampled_transfers,"
        "from_Agency_Sampled_Transactions,to_Agency_Sampled_Transactions,estimated_transfers,"
        "estimated_from_agency_transactions,estimated_to_agency_transactions\n"
        "2014,3,4,6,Rail,Bus,1,390,500,2,780,1000\n", "pairs.csv")
    r = sources.read_pair_day(spark, path).collect()[0]
    assert r["estimated_transfers"] == 2 * r["sampled_transfers"] and r["Month"] == 3


def test_manifest_pairs_files(spark):
    names = spark.createDataFrame([
        ("2014 - 03 Transactions part1.csv",), ("2014 - 03 Transactions part2.csv",),
        ("2014 - 03 Transfers.csv",), ("2014 - 04 Transfers.csv",), ("readme.txt",),
    ], "name string")
    m = {(r["year"], r["month"], r["Transactions"]): r["Transfers"]
         for r in sources.file_manifest(names).collect()}
    assert m == {
        (2014, 3, "2014 - 03 Transactions part1.csv"): "2014 - 03 Transfers.csv",
        (2014, 3, "2014 - 03 Transactions part2.csv"): None,
        (2014, 4, None): "2014 - 04 Transfers.csv",
    }


def test_driver_mapping(spark):
    taps = sources.taps(spark, "/root/testdata/sf0.001")
    assert taps.count() == 1000
    assert taps.select("cardid_anony").distinct().count() == 2
    rules = sources.transfer_rules(spark, "/root/testdata/sf0.001")
    assert rules.count() == 25 * 25 - 7  # same-agency rules left out for keys 0,4,...,24
