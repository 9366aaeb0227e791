"""Fixed-window transfer flags, the operator-pair matrix and rule transfers."""

from conftest import by_seq, make_taps

from faretrail.operators import classify_rule_transfers, create_transfer_df, identify_transfer_for_time


def test_window_is_inclusive(spark):
    taps = make_taps(spark, [
        {"minutes": 0}, {"minutes": 120}, {"minutes": 240.5},
    ])
    f = by_seq(identify_transfer_for_time(taps, 120))
    assert [f[i]["is_transfer"] for i in (0, 1, 2)] == [0, 1, 0]
    assert f[1]["time_from_prev_tagon"] == 120.0 and f[1]["time_from_prev"] is None


def test_tag_off_gap_from_previous_tag_on(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "subtype": 1},
        {"minutes": 100, "subtype": 2},
        {"minutes": 130, "subtype": 3},   # gap = 130 - lag(tagon_time) where lag row is a single tap (null)
        {"minutes": 140, "subtype": 2},
        {"minutes": 150, "subtype": 3},   # gap = 150 - 100 (previous ride's tag-on) = 50
    ])
    f = by_seq(identify_transfer_for_time(taps, 60))
    assert f[2]["time_from_prev"] is None and f[2]["is_transfer"] == 0
    assert f[4]["time_from_prev"] == 50.0 and f[4]["is_transfer"] == 1


def test_missing_transfer_name_dropped_before_lag(spark):
    taps = make_taps(spark, [
        {"minutes": 0},
        {"minutes": 10, "participantname_transfer": None},
        {"minutes": 100},
    ])
    f = by_seq(identify_transfer_for_time(taps, 95))
    assert sorted(f) == [0, 2]
    assert f[2]["time_from_prev_tagon"] == 100.0 and f[2]["is_transfer"] == 0


def test_pair_without_transfers_kept_with_zeros(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "participantname": "X", "operatorid": 3, "transferoperator": 7},
        {"minutes": 500, "participantname": "X", "operatorid": 3, "transferoperator": 7},
    ])
    m = create_transfer_df(taps, 120).collect()
    assert len(m) == 1
    row = m[0].asDict()
    assert row["num_transfers"] == 0 and row["num_discounted"] == 0 and row["transfer_revenue"] == 0.0
    assert row["from_operator_id"] == 7 and row["to_operator_id"] == 3


def test_matrix_sums_and_product_filter(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "purseamount": 1.10},
        {"minutes": 10, "purseamount": 2.20, "transferdiscountflag": 1},
        {"minutes": 20, "purseamount": 3.30, "productcategory": 2},
        {"minutes": 30, "purseamount": 4.40},
    ])
    row = create_transfer_df(taps, 120).collect()[0].asDict()
    assert row["num_transfers"] == 2 and row["num_discounted"] == 1
    assert row["transfer_revenue"] == 6.6  # exact decimal sum, no float drift


def test_transfer_counts_monotone_in_window(spark):
    taps = make_taps(spark, [{"minutes": m} for m in (0, 15, 45, 100, 200, 400)])
    counts = [create_transfer_df(taps, w).collect()[0]["num_transfers"] for w in (10, 30, 60, 120, 240)]
    assert counts == sorted(counts)


def test_rule_transfers(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "participantname": "A"},
        {"minutes": 30, "participantname": "B"},
        {"minutes": 50, "participantname": "C"},
        {"minutes": 80, "participantname": "C"},
    ])
    rules = spark.createDataFrame(
        [("A", "B", 30), ("B", "C", 10)], "from_AgencyName string, to_AgencyName string, max_time int")
    r = by_seq(classify_rule_transfers(taps, rules))
    assert r[1]["is_rule_transfer"] is True       # 30 <= 30, inclusive
    assert r[2]["is_rule_transfer"] is False      # 20 > 10
    assert r[3]["is_rule_transfer"] is False and r[3]["max_time"] is None  # no rule
    assert r[0]["is_rule_transfer"] is False


def test_alight_to_board_gap(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "subtype": 2},
        {"minutes": 50, "subtype": 3},     # ride 1: 0 -> 50
        {"minutes": 70, "subtype": 2},
        {"minutes": 100, "subtype": 3},    # ride 2: boards at 70, 20 min after alighting
    ])
    src = by_seq(identify_transfer_for_time(taps, 30))
    a2b = by_seq(identify_transfer_for_time(taps, 30, gap="alight_to_board"))
    assert src[3]["time_from_prev"] == 100.0 and src[3]["is_transfer"] == 0
    assert a2b[3]["time_from_prev"] == 20.0 and a2b[3]["is_transfer"] == 1
