"""Transfers between operators: fixed-window flags, the operator-pair matrix and
rule-based classification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from faretrail.functions.scalars import exact_sum, minutes_between
from faretrail.operators.journeys import add_transfer_time
from faretrail.operators.ordering import CardOrder, resolve
from faretrail.operators.rides import as_rides
from faretrail.schema import TIME


def identify_transfer_for_time(tr: DataFrame, mins: float, order: CardOrder | None = None,
                               gap: str = "source", rides: bool = False) -> DataFrame:
    """Flag rides that start within ``mins`` (inclusive) of the previous ride.

    Expects taps (rides are derived here), or with ``rides=True`` the rides
    themselves, which are taken as they are. Rides without a transfer-operator
    name are dropped *before* the lag. A missing gap is not a transfer.

    ``gap='source'`` (default, the source model's definition): for a
    single-tap ride the gap is measured from the previous ride's time, for a
    tag-off ride from the previous ride's tag-on time to this tag-off.
    ``gap='alight_to_board'``: from the previous ride's last tap to this
    ride's boarding (its tag-on time, or its own time for a single tap).
    """
    if gap not in ("source", "alight_to_board"):
        raise ValueError("gap must be 'source' or 'alight_to_board'")
    order = resolve(order)
    ridden = tr if rides else as_rides(tr, order)
    ridden = ridden.where(F.col("participantname_transfer").isNotNull())

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        tagon = F.col("tagon_time")
        if gap == "source":
            gap_single = F.when(tagon.isNull(), minutes_between(F.lag(TIME).over(w), TIME))
            gap_tagoff = F.when(tagon.isNotNull(), minutes_between(F.lag("tagon_time").over(w), TIME))
        else:
            board = F.coalesce(tagon, F.col(TIME))
            gap_single = F.when(tagon.isNull(), minutes_between(F.lag(TIME).over(w), board))
            gap_tagoff = F.when(tagon.isNotNull(), minutes_between(F.lag(TIME).over(w), board))
        df = df.withColumn("time_from_prev_tagon", gap_single).withColumn("time_from_prev", gap_tagoff)
        hit = (F.col("time_from_prev") <= F.lit(mins)) | (F.col("time_from_prev_tagon") <= F.lit(mins))
        return df.withColumn("is_transfer", F.coalesce(hit, F.lit(False)).cast("int"))

    return order.apply(ridden, build, halo=1)


def transfer_summary(flagged: DataFrame, product_category: int | None = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Operator-pair matrix from flagged rides (partial + final aggregation).

    ``by`` adds leading grouping columns (e.g. ``service_date``).
    """
    if product_category is not None:
        flagged = flagged.where(F.col("productcategory") == product_category)
    hit = F.col("is_transfer") == 1
    return flagged.groupBy(*by, "participantname_transfer", "participantname").agg(
        F.avg("transferoperator").cast("int").alias("from_operator_id"),
        F.avg("operatorid").cast("int").alias("to_operator_id"),
        F.sum("is_transfer").cast("long").alias("num_transfers"),
        F.coalesce(F.sum(F.when(hit, F.col("transferdiscountflag"))), F.lit(0)).cast("long").alias("num_discounted"),
        F.coalesce(exact_sum(F.when(hit, F.col("purseamount"))), F.lit(0.0)).alias("transfer_revenue"),
    )


def create_transfer_df(tr: DataFrame, mins: float, order: CardOrder | None = None,
                       product_category: int | None = 1, by: tuple[str, ...] = (), rides: bool = False) -> DataFrame:
    """Transfers between every (from, to) operator pair within ``mins``.

    Pairs with rides but no transfers are kept with zero counts. For input
    spanning several service days pass an ``order`` keyed by
    ``(cardid_anony, service_date)`` and ``by=("service_date",)``. ``rides``:
    the input holds rides, not taps.
    """
    return transfer_summary(identify_transfer_for_time(tr, mins, order, rides=rides), product_category, by)


def classify_rule_transfers(tr: DataFrame, rules: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """A ride is a transfer when its gap from the previous ride is within the
    (previous agency, this agency) rule's ``max_time`` (inclusive).

    ``rules`` has ``from_AgencyName, to_AgencyName, max_time``; a pair without
    a rule is not a transfer. The rule table is a small lookup (left join).
    """
    timed = add_transfer_time(tr, order)
    r = rules.select(
        F.col("from_AgencyName").alias("previous_participant"),
        F.col("to_AgencyName").alias("participantname"),
        F.col("max_time"),
    )
    out = timed.join(r, ["previous_participant", "participantname"], "left")
    ok = F.coalesce(F.col("transfer_time") <= F.col("max_time"), F.lit(False))
    return out.select(*timed.columns, "max_time", ok.alias("is_rule_transfer"))
