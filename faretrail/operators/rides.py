"""Taps to rides: tag-on time, trip duration and trip cost on tag-off taps.

A tag-off tap (subtype 3 or 5) takes the time of the card's previous tap as
its tag-on time; a subtype-3 tag-off nets the purse amount against the
previous tap. Tag-on taps (2, 4) are then dropped; a null subtype is dropped
too. The windows run before the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from faretrail.functions.scalars import minutes_between
from faretrail.operators.ordering import CardOrder, resolve
from faretrail.schema import NETTED_TAG_OFF, TAG_OFF_SUBTYPES, TAG_ON_SUBTYPES, TIME


def _previous(df: DataFrame, w: WindowSpec, cols) -> DataFrame:
    """The previous tap's values of ``cols`` in one window pass (``_prev_<col>``)."""
    return df.select("*", *[F.lag(c).over(w).alias(f"_prev_{c}") for c in cols])


def _tagon_exprs(strict_pairing: bool = False) -> dict:
    sub = F.col("subtype")
    tagging_off = (sub == TAG_OFF_SUBTYPES[0]) | (sub == TAG_OFF_SUBTYPES[1])
    paired = tagging_off
    if strict_pairing:
        # the previous tap must be the matching tag-on (2 before 3, 4 before 5) of the same operator
        paired = paired & (F.col("_prev_subtype") == sub - 1) & (F.col("_prev_operatorid") == F.col("operatorid"))
    tagon = F.when(paired, F.col(f"_prev_{TIME}"))
    return {"tagging_off": tagging_off, "tagon_time": tagon, "trip_duration": minutes_between(tagon, TIME)}


def _cost_exprs() -> dict:
    sub = F.col("subtype")
    prev = F.when(sub == NETTED_TAG_OFF, F.col("_prev_purseamount"))
    cost = F.when(sub == NETTED_TAG_OFF, prev - F.col("purseamount")).when(sub != NETTED_TAG_OFF, F.col("purseamount"))
    return {"previous_purseamount": prev, "trip_cost": cost}


def _ride_cols(df: DataFrame, w: WindowSpec, tagon: bool = True, cost: bool = True,
               strict_pairing: bool = False) -> DataFrame:
    need = ([TIME] if tagon else []) + (["purseamount"] if cost else [])
    if tagon and strict_pairing:
        need += ["subtype", "operatorid"]
    d = _previous(df, w, need)
    exprs = {**(_tagon_exprs(strict_pairing) if tagon else {}), **(_cost_exprs() if cost else {})}
    return d.select(*[c for c in df.columns if c not in exprs], *[e.alias(n) for n, e in exprs.items()])


def add_tagon_time(tr: DataFrame, order: CardOrder | None = None, strict_pairing: bool = False) -> DataFrame:
    """Add ``tagging_off``, ``tagon_time`` and ``trip_duration`` (minutes).

    By default any previous tap is taken as the tag-on; ``strict_pairing``
    requires the matching tag-on subtype on the same operator.
    """
    return resolve(order).apply(tr, lambda d, w: _ride_cols(d, w, cost=False, strict_pairing=strict_pairing),
                                halo=1)


def add_trip_cost(tr: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """Add ``previous_purseamount`` and ``trip_cost``."""
    return resolve(order).apply(tr, lambda d, w: _ride_cols(d, w, tagon=False), halo=1)


def is_ride() -> Column:
    sub = F.col("subtype")
    return (sub != TAG_ON_SUBTYPES[0]) & (sub != TAG_ON_SUBTYPES[1])


def as_rides(tr: DataFrame, order: CardOrder | None = None, strict_pairing: bool = False) -> DataFrame:
    """One row per ride: both window stages share one exchange, then filter."""
    if "tagon_time" in tr.columns:
        raise ValueError("as_rides expects taps, not rides (tagon_time already present)")
    both = resolve(order).apply(tr, lambda d, w: _ride_cols(d, w, strict_pairing=strict_pairing), halo=1)
    return both.where(is_ride())


def day_of_rides(tr: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """Rides of a service-day table (compose with ``extract.service_day``)."""
    return as_rides(tr, order)
