"""Rides: tag-on time, duration, cost; tag-on rows dropped after the windows."""

import datetime as dt

from conftest import T0, by_seq, make_taps

from faretrail.operators import add_trip_cost, as_rides


def test_tag_pairs_and_unpaired_tag_off(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "subtype": 2, "purseamount": 5.0},    # tag-on
        {"minutes": 30, "subtype": 3, "purseamount": 3.0},   # tag-off, netted
        {"minutes": 40, "subtype": 4, "purseamount": 0.0},   # rail tag-on
        {"minutes": 60, "subtype": 5, "purseamount": 4.2},   # rail tag-off
        {"minutes": 75, "subtype": 3, "purseamount": 1.0},   # tag-off with no tag-on before it
        {"minutes": 90, "subtype": 1, "purseamount": 2.5},   # single tap
    ])
    r = by_seq(as_rides(taps))
    assert sorted(r) == [1, 3, 4, 5]
    assert r[1]["tagon_time"] == T0 and r[1]["trip_duration"] == 30.0
    assert r[1]["previous_purseamount"] == 5.0 and r[1]["trip_cost"] == 2.0
    assert r[3]["tagon_time"] == T0 + dt.timedelta(minutes=40) and r[3]["trip_duration"] == 20.0
    assert r[3]["previous_purseamount"] is None and r[3]["trip_cost"] == 4.2
    # the previous row is trusted as the tag-on whatever it was
    assert r[4]["tagon_time"] == T0 + dt.timedelta(minutes=60)
    assert abs(r[4]["trip_cost"] - 3.2) < 1e-12
    assert r[5]["tagging_off"] is False and r[5]["tagon_time"] is None and r[5]["trip_cost"] == 2.5


def test_null_subtype_dropped_and_cost_null(spark):
    taps = make_taps(spark, [{"subtype": None}, {"subtype": 1}])
    costs = by_seq(add_trip_cost(taps))
    assert costs[0]["trip_cost"] is None
    assert sorted(by_seq(as_rides(taps))) == [1]


def test_single_tap_card(spark):
    r = by_seq(as_rides(make_taps(spark, [{"subtype": 3}])))
    assert r[0]["tagon_time"] is None and r[0]["previous_purseamount"] is None


def test_same_instant_tie_broken_by_sequence(spark):
    taps = make_taps(spark, [
        {"minutes": 5, "subtype": 3, "sequencenumber": 11, "purseamount": 1.0},
        {"minutes": 5, "subtype": 2, "sequencenumber": 10, "purseamount": 4.0},
    ])
    r = by_seq(as_rides(taps))
    assert list(r) == [11]
    assert r[11]["previous_purseamount"] == 4.0 and r[11]["trip_duration"] == 0.0


def test_rides_rejects_rides(spark):
    import pytest
    rides = as_rides(make_taps(spark, [{"subtype": 1}]))
    with pytest.raises(ValueError):
        as_rides(rides)


def test_strict_pairing(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "subtype": 1},                    # not a tag-on
        {"minutes": 10, "subtype": 3},                   # lenient: takes minute 0; strict: none
        {"minutes": 20, "subtype": 4, "operatorid": 4},
        {"minutes": 30, "subtype": 5, "operatorid": 4},  # matching pair
    ])
    lenient = by_seq(as_rides(taps))
    strict = by_seq(as_rides(taps, strict_pairing=True))
    assert lenient[1]["tagon_time"] == T0 and strict[1]["tagon_time"] is None
    assert strict[3]["trip_duration"] == 10.0
