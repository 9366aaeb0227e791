"""Journeys: strict gap, global dense ids, legs per journey."""

from conftest import by_seq, make_taps

from faretrail.operators import add_journey_id, add_transfer_time


def test_gap_is_strict_and_ids_are_global(spark):
    rows = [{"cardid_anony": "b", "minutes": m} for m in (0, 59.99, 119.98, 300)]
    rows += [{"cardid_anony": "a", "minutes": m, "participantname": "X"} for m in (0, 60, 61)]
    for i, r in enumerate(rows):
        r["sequencenumber"] = i
    j = by_seq(add_journey_id(make_taps(spark, rows)))
    # card "a" sorts first: journeys 1 (0), 2 (60, 61); card "b": 3 (0, 59.99, 119.98), 4 (300)
    assert [j[i]["journey_id"] for i in (4, 5, 6)] == [1, 2, 2]
    assert [j[i]["journey_id"] for i in (0, 1, 2, 3)] == [3, 3, 3, 4]
    assert [j[i]["num_legs"] for i in (4, 5, 6, 0, 3)] == [1, 2, 2, 3, 1]
    assert j[5]["is_transfer"] is False and j[6]["is_transfer"] is True
    assert j[0]["is_transfer"] is False and j[0]["transfer_time"] is None


def test_transfer_time_previous_participant(spark):
    taps = make_taps(spark, [
        {"minutes": 0, "participantname": "P"},
        {"minutes": 5, "subtype": 2, "participantname": "Q"},
        {"minutes": 15, "subtype": 3, "participantname": "Q"},
    ])
    t = by_seq(add_transfer_time(taps))
    assert sorted(t) == [0, 2]
    assert t[2]["previous_participant"] == "P" and t[2]["transfer_time"] == 15.0


def test_single_tap_card_is_one_leg(spark):
    j = add_journey_id(make_taps(spark, [{"minutes": 0}])).collect()
    assert len(j) == 1 and j[0]["journey_id"] == 1 and j[0]["num_legs"] == 1


def test_journeys_and_transfers_of_given_rides(spark):
    """Rides handed over as rides give what their taps give."""
    from faretrail.operators import add_journey_id, as_rides
    from faretrail.plans import catalog

    taps = catalog.Inputs(spark, "/root/testdata/sf0.001").enriched
    cols = ["cardid_anony", "sequencenumber", "journey_id", "num_legs"]
    got = add_journey_id(as_rides(taps), rides=True).select(*cols).collect()
    assert sorted(got) == sorted(add_journey_id(taps).select(*cols).collect())
