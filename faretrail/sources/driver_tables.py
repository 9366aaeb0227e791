"""Map the driver's generic test tables onto the smart-card data model.

The driver tables hold no card taps, so taps are derived from ``events`` and
the lookups from ``nation`` and ``part``. The derivation is a pure projection
(no shuffle), so the work of every query grows with ``events``.

With ``k`` the integer inside ``props``:

==========================  =================================================
sequencenumber              event_id
applicationserialnumber     user_id div 10
cardid_anony                sha1 of the serial as text
transaction_time            ts (generationtime is the same instant)
operatorid                  4 if k < 40 else k % 25
subtype                     click 1, view 2, signup 3, error 4, purchase 5
transferoperator            null if k % 5 = 0 else (k * 7) % 25
transferdiscountflag        1 if k % 3 = 0 else 0
productcategory             1 + (k div 2) % 2
contractid                  k % 7
purseamount                 value
originlocation              k % 10 (text)
destinationlocation         null if k % 7 = 0 else (k * 3) % 10 (text)
routeid                     k % 20
==========================  =================================================
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrail.schema import DAY_COLUMNS, RAW_SCHEMA

# Event type to tap subtype.
EVENT_SUBTYPES = {"click": 1, "view": 2, "signup": 3, "error": 4, "purchase": 5}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _typed_null(name: str):
    return F.lit(None).cast(RAW_SCHEMA[name].dataType).alias(name)


def raw_transactions(events: DataFrame) -> DataFrame:
    """Raw fare transactions (UTC ``generationtime``, serials, no card hash)."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    subtype = F.lit(None).cast("int")
    for name, code in EVENT_SUBTYPES.items():
        subtype = F.when(F.col("event_type") == name, F.lit(code)).otherwise(subtype)
    kk = F.col("k")
    derived = {
        "generationtime": F.col("ts"),
        "applicationserialnumber": F.expr("user_id div 10"),
        "operatorid": F.when(kk < 40, F.lit(4)).otherwise(kk % 25),
        "routeid": kk % 20,
        "subtype": subtype,
        "contractid": kk % 7,
        "productcategory": 1 + F.expr("(k div 2) % 2"),
        "transferoperator": F.when(kk % 5 == 0, F.lit(None)).otherwise((kk * 7) % 25),
        "transferdiscountflag": F.when(kk % 3 == 0, F.lit(1)).otherwise(F.lit(0)),
        "originlocation": (kk % 10).cast("string"),
        "sequencenumber": F.col("event_id"),
        "destinationlocation": F.when(kk % 7 == 0, F.lit(None)).otherwise((kk * 3) % 10).cast("string"),
        "purseamount": F.col("value"),
    }
    cols = []
    for field in RAW_SCHEMA.fields:
        if field.name in derived:
            cols.append(derived[field.name].cast(field.dataType).alias(field.name))
        else:
            cols.append(_typed_null(field.name))
    return ev.select(*cols)


def day_taps(raw: DataFrame, keep_serial: bool = True) -> DataFrame:
    """Taps in day-table shape without a time-zone shift (fixture mode).

    ``transaction_time`` equals ``generationtime``; the card id is the SHA-1 of
    the serial. Use :func:`faretrail.operators.extract.service_day` for the
    zone-shifted, day-bounded version.
    """
    cols = []
    for name in DAY_COLUMNS:
        if name == "transaction_time":
            cols.append(F.col("generationtime").alias(name))
        elif name == "cardid_anony":
            cols.append(F.sha1(F.col("applicationserialnumber").cast("string")).alias(name))
        elif name == "applicationserialnumber" and not keep_serial:
            continue
        else:
            cols.append(F.col(name))
    return raw.select(*cols)


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_taps(raw_transactions(read_table(spark, sf_dir, "events")))


def participants_from(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("int").alias("participantid"),
        F.col("n_name").alias("participantname"),
    )


def routes_from(part: DataFrame) -> DataFrame:
    """Routes from the whole of ``part``, folded to one row a key: the name of its smallest part."""
    key = [(F.col("p_partkey") % 20).cast("int").alias("routeid"),
           F.expr("(p_partkey div 20) % 25").cast("int").alias("participantid")]
    return part.groupBy(*key).agg(F.min_by("p_name", "p_partkey").alias("routename"))


def locations_from(part: DataFrame) -> DataFrame:
    """Locations from the whole of ``part``, folded to one row a key: the name of its smallest part."""
    key = [(F.col("p_partkey") % 10).cast("int").alias("locationcode"),
           F.expr("(p_partkey div 10) % 25").cast("int").alias("participantid")]
    return part.groupBy(*key).agg(F.min_by("p_name", "p_partkey").alias("locationname"))


def contract_product_map_from(nation: DataFrame) -> DataFrame:
    """(issuerid, producttype, contracttype): contract types 0..5 per issuer (type 6 occurs in taps only)."""
    return nation.select(
        F.col("n_nationkey").cast("int").alias("issuerid"),
        F.explode(F.sequence(F.lit(0), F.lit(5))).alias("contracttype"),
    ).select("issuerid", (F.col("contracttype") % 3).alias("producttype"), "contracttype")


def products_from(nation: DataFrame) -> DataFrame:
    """(issuerid, producttype, description, productcategory)."""
    return nation.select(
        F.col("n_nationkey").cast("int").alias("issuerid"),
        F.col("n_name"),
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("producttype"),
    ).select(
        "issuerid",
        "producttype",
        F.concat(F.col("n_name"), F.lit(" product "), F.col("producttype").cast("string")).alias("description"),
        (1 + F.col("producttype") % 2).alias("productcategory"),
    )


def transfer_rules_from(nation: DataFrame) -> DataFrame:
    """Agency-pair rules (from_AgencyName, to_AgencyName, max_time) over nations.

    ``max_time = 10 + ((from*3 + to) % 7) * 10``; a same-agency rule is absent
    when ``from % 4 = 0``. Pairs come from exploding each nation's key range
    and joining the target nation on its key (an equi-join).
    """
    n = nation.select("n_nationkey", "n_name")
    frm = n.select(
        F.col("n_nationkey").alias("from_key"), F.col("n_name").alias("from_AgencyName"),
        F.explode(F.sequence(F.lit(0), n.agg(F.max("n_nationkey")).scalar())).alias("to_key"),
    )
    to = n.select(F.col("n_nationkey").alias("to_key"), F.col("n_name").alias("to_AgencyName"))
    pairs = frm.join(to, "to_key")
    keep = (F.col("from_key") != F.col("to_key")) | (F.col("from_key") % 4 != 0)
    return pairs.where(keep).select(
        "from_AgencyName", "to_AgencyName",
        (10 + ((F.col("from_key") * 3 + F.col("to_key")) % 7) * 10).cast("int").alias("max_time"),
    )


def sampled_trips_from(rides: DataFrame) -> DataFrame:
    """Trips on sampled days, as a table of them would be given, from readable rides.

    The sequence ids are a permutation of the sequence numbers (a prime modulus)
    with some missing, so their order is not that of the times; the week is
    given too and is not that of the month.
    """
    on = F.coalesce(F.col("tagon_time"), F.col("transaction_time"))
    day = F.to_date(on - F.expr("INTERVAL 3 HOURS"))
    return rides.select(
        F.col("cardid_anony").alias("ClipperCardID"),
        F.year(day).alias("Year"), F.month(day).alias("Month"), F.dayofweek(day).alias("CircadianDayOfWeek"),
        (1 + F.col("sequencenumber") % 3).cast("int").alias("RandomWeekID"),
        F.when(F.col("sequencenumber") % 11 != 0, F.col("sequencenumber") * 48271 % 2147483647).alias("TripSequenceID"),
        F.date_format(on, "HH:mm:ss").alias("TagOnTime_Time"),
        F.col("locationname_origin").alias("TagOnLocationName"), F.col("locationname_destination").alias("TagOffLocationName"),
    )


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participants_from(read_table(spark, sf_dir, "nation"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes_from(read_table(spark, sf_dir, "part"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations_from(read_table(spark, sf_dir, "part"))


def contract_product_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_product_map_from(read_table(spark, sf_dir, "nation"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products_from(read_table(spark, sf_dir, "nation"))


def transfer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer_rules_from(read_table(spark, sf_dir, "nation"))
