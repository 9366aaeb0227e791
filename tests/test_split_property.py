"""Property test: for random tap tables (ties, null subtypes, gaps of every
size, empty time segments) the hot-card split gives exactly the plain result."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faretrail.operators import (
    CardOrder, add_journey_id, as_focal_journeys, focal_to_focal, identify_transfer_for_time,
)

from conftest import TAP_SCHEMA, T0

tap = st.fixed_dictionaries({
    "card": st.sampled_from(["a", "b", "c"]),
    "minute": st.integers(min_value=0, max_value=600),
    "subtype": st.sampled_from([1, 2, 3, 4, 5, None]),
    "operatorid": st.sampled_from([1, 4, 9]),
})


def _frame(spark, taps):
    rows = []
    for i, t in enumerate(taps):
        rows.append(tuple({
            "cardid_anony": t["card"], "transaction_time": T0 + dt.timedelta(minutes=t["minute"]),
            "sequencenumber": i, "operatorid": t["operatorid"], "subtype": t["subtype"], "purseamount": 1.0,
            "transferoperator": 1, "transferdiscountflag": 0, "productcategory": 1, "contractid": 0,
            "routeid": 0, "originlocation": i % 3, "destinationlocation": 1, "participantname": f"op{t['operatorid']}",
            "participantname_transfer": "x", "routename": "r", "locationname_origin": "o",
            "locationname_destination": None if i % 5 == 0 else "d",
        }[f.name] for f in TAP_SCHEMA.fields))
    return spark.createDataFrame(rows, TAP_SCHEMA)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(taps=st.lists(tap, min_size=1, max_size=40), segment_rows=st.integers(min_value=1, max_value=6))
def test_split_matches_plain(spark, taps, segment_rows):
    df = _frame(spark, taps)
    split = CardOrder.detect(df, segment_rows=segment_rows)
    for op in (
        lambda d, o: as_focal_journeys(d, order=o),
        lambda d, o: focal_to_focal(d, order=o),
        lambda d, o: identify_transfer_for_time(d, 45, o),
        lambda d, o: add_journey_id(d, 30, o),
    ):
        assert _rows(op(df, None)) == _rows(op(df, split))
