"""Focal-operator trips: flags, connections on both sides, focal-to-focal pairs."""

from conftest import by_seq, make_taps

from faretrail.operators import (
    as_focal_journeys, combined_focal_transactions, focal_identify, focal_lag_and_lead_metadata,
    focal_to_focal, tap_counts,
)
from faretrail.functions import spread_time_column

BUS, RAIL, FERRY = 1, 4, 9


def _trip(spark):
    return make_taps(spark, [
        {"minutes": 0, "operatorid": BUS, "participantname": "Bus", "routename": "B1"},
        {"minutes": 20, "operatorid": RAIL, "subtype": 4, "participantname": "Rail", "routename": None,
         "locationname_destination": None},
        {"minutes": 50, "operatorid": RAIL, "subtype": 5, "participantname": "Rail", "routename": None,
         "locationname_destination": "Downtown"},
        {"minutes": 70, "operatorid": FERRY, "participantname": "Ferry", "routename": "F1"},
    ])


def test_connections_on_both_sides(spark):
    j = as_focal_journeys(_trip(spark)).collect()
    assert len(j) == 1
    row = j[0].asDict()
    assert row["sequencenumber"] == 2
    assert row["transfer_from_operator"] == "Bus" and row["transfer_from_route"] == "B1"
    assert row["transfer_to_operator"] == "Ferry" and row["transfer_to_route"] == "F1"
    assert row["transfer_from_operator_time"] == 20.0 and row["transfer_to_operator_time"] == 20.0
    assert row["timediff"] == 30.0


def test_edges_stay_null(spark):
    taps = make_taps(spark, [{"minutes": 0, "operatorid": RAIL}, {"minutes": 5, "operatorid": BUS}])
    f = by_seq(focal_identify(taps))
    assert f[0]["from_focal"] is None and f[0]["to_focal"] is False
    assert f[0]["entrance_from_not_focal"] is False  # is & to(false) -> false
    assert f[1]["to_focal"] is None and f[1]["is_focal"] is False
    single = by_seq(focal_identify(make_taps(spark, [{"operatorid": RAIL}])))
    assert single[0]["exit_to_not_focal"] is None and single[0]["entrance_from_not_focal"] is None


def test_threshold_acts_on_rounded_gap(spark):
    # 179.996 minutes rounds to 180.00, which is not under 180
    taps = make_taps(spark, [
        {"minutes": 0, "operatorid": RAIL, "subtype": 4},
        {"minutes": 30, "operatorid": RAIL, "subtype": 5},
        {"minutes": 30 + 179.996, "operatorid": BUS, "participantname": "Bus"},
        {"minutes": 400, "operatorid": RAIL, "subtype": 4},
        {"minutes": 420, "operatorid": RAIL, "subtype": 5},
        {"minutes": 420 + 179.99, "operatorid": BUS, "participantname": "Bus2"},
    ])
    m = by_seq(focal_lag_and_lead_metadata(focal_identify(taps)))
    assert m[1]["transfer_to_operator_time"] == 180.0 and m[1]["transfer_to_not_focal"] is False
    assert m[1]["transfer_to_operator"] is None
    assert m[4]["transfer_to_operator_time"] == 179.99 and m[4]["transfer_to_operator"] == "Bus2"


def test_cards_without_focal_taps_are_dropped(spark):
    taps = make_taps(spark, [
        {"cardid_anony": "bus-only", "operatorid": BUS},
        {"cardid_anony": "bus-only", "operatorid": BUS, "minutes": 3},
    ])
    assert as_focal_journeys(taps).count() == 0


def test_focal_to_focal_and_pairs(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "operatorid": RAIL, "subtype": 4},
        {"minutes": 20, "operatorid": RAIL, "subtype": 5, "originlocation": 1},
        {"minutes": 60, "operatorid": RAIL, "subtype": 4},
        {"minutes": 80, "operatorid": RAIL, "subtype": 5, "originlocation": 7},
        {"minutes": 600, "operatorid": RAIL, "subtype": 4},
        {"minutes": 620, "operatorid": RAIL, "subtype": 5, "originlocation": 8},
        {"cardid_anony": "single", "minutes": 0, "operatorid": RAIL, "subtype": 4},
        {"cardid_anony": "single", "minutes": 9, "operatorid": RAIL, "subtype": 5},
    ])
    ff = by_seq(focal_to_focal(taps))
    # card "single" has one survivor and is dropped; the 620 row is kept (its own gap is long,
    # but it has no next row, so only rows with a near gap on either side stay)
    assert sorted(ff) == [1, 3]
    assert ff[3]["timediff"] == 60.0 and ff[1]["first_trip"] is True and ff[3]["second_trip"] is True
    pairs = by_seq(combined_focal_transactions(focal_to_focal(taps)))
    assert sorted(pairs) == [1]
    assert pairs[1]["second_originlocation"] == 7 and pairs[1]["second_timediff"] == 60.0


def test_tap_counts(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "operatorid": RAIL}, {"minutes": 1, "operatorid": RAIL},
        {"minutes": 2, "operatorid": BUS}, {"minutes": 60 * 24, "operatorid": BUS},
    ])
    marked = spread_time_column(focal_identify(taps), prefix="")
    c = by_seq(tap_counts(marked))
    assert [c[i]["transaction_count"] for i in range(4)] == [3, 3, 3, 1]
    assert [c[i]["focal_tr_count"] for i in range(4)] == [2, 2, 1, 1]
    assert [c[i]["tr_count_diff"] for i in range(4)] == [1, 1, 2, 0]
