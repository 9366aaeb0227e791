from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from faretrail.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return get_session("local[4]", "faretrail-tests", **{"spark.sql.shuffle.partitions": "4"})


TAP_SCHEMA = T.StructType([
    T.StructField("cardid_anony", T.StringType()),
    T.StructField("transaction_time", T.TimestampNTZType()),
    T.StructField("sequencenumber", T.LongType()),
    T.StructField("operatorid", T.IntegerType()),
    T.StructField("subtype", T.IntegerType()),
    T.StructField("purseamount", T.DoubleType()),
    T.StructField("transferoperator", T.IntegerType()),
    T.StructField("transferdiscountflag", T.IntegerType()),
    T.StructField("productcategory", T.IntegerType()),
    T.StructField("contractid", T.IntegerType()),
    T.StructField("routeid", T.IntegerType()),
    T.StructField("originlocation", T.IntegerType()),
    T.StructField("destinationlocation", T.IntegerType()),
    T.StructField("participantname", T.StringType()),
    T.StructField("participantname_transfer", T.StringType()),
    T.StructField("routename", T.StringType()),
    T.StructField("locationname_origin", T.StringType()),
    T.StructField("locationname_destination", T.StringType()),
])

T0 = dt.datetime(2024, 1, 10, 8, 0, 0)

DEFAULTS = {
    "cardid_anony": "card-a", "operatorid": 1, "subtype": 1, "purseamount": 2.0,
    "transferoperator": 1, "transferdiscountflag": 0, "productcategory": 1, "contractid": 0,
    "routeid": 0, "originlocation": 1, "destinationlocation": 2, "participantname": "OP1",
    "participantname_transfer": "OP1", "routename": "R1", "locationname_origin": "A",
    "locationname_destination": "B",
}


def make_taps(spark: SparkSession, rows: list[dict]):
    """Taps from partial dicts; ``minutes`` is an offset from T0, seq defaults to the row index."""
    out = []
    for i, r in enumerate(rows):
        full = {**DEFAULTS, **{k: v for k, v in r.items() if k != "minutes"}}
        full.setdefault("transaction_time", T0 + dt.timedelta(minutes=r.get("minutes", i)))
        full.setdefault("sequencenumber", i)
        out.append(tuple(full.get(f.name) for f in TAP_SCHEMA.fields))
    return spark.createDataFrame(out, TAP_SCHEMA)


def by_seq(df) -> dict:
    return {r["sequencenumber"]: r.asDict() for r in df.collect()}
