"""Focal-operator (rail) trips and the connections on each side of them.

A focal trip is a tag-on and a tag-off on the focal operator. For each trip
the operator and route the card used just before boarding and just after
alighting are attached when the gap is under ``window_min`` minutes. Flags at
a card's first or last tap stay null (three-valued logic), as in the source
model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faretrail.functions.scalars import minutes_between, round2
from faretrail.operators.ordering import CardOrder, null_safe_join, resolve
from faretrail.schema import ADJACENT_WINDOW_MIN, FOCAL_JOURNEY_COLUMNS, FOCAL_OPERATOR, FOCAL_TAG_OFF, TIME
from faretrail.session import materialize


def cards_using_operator(tr: DataFrame, operator: int = FOCAL_OPERATOR, keys=("cardid_anony",),
                         order: CardOrder | None = None) -> DataFrame:
    """All taps of cards with at least one tap on ``operator``.

    Plain plan: a per-card window flag (one scan, one card exchange that later
    card windows reuse). With split hot cards a card spans several window
    partitions, so the card list is built with a map-side distinct and
    semi-joined instead.
    """
    order = resolve(order)
    if order.hot is None:
        used = F.max((F.col("operatorid") == operator).cast("int")).over(Window.partitionBy(*keys))
        return tr.withColumn("_uses", used).where(F.col("_uses") == 1).drop("_uses")
    riders = tr.where(F.col("operatorid") == operator).select(*keys).distinct()
    return null_safe_join(tr, riders, list(keys), "left_semi")


def _identify_cols(df: DataFrame, w: WindowSpec, focal: int) -> DataFrame:
    op = F.col("operatorid")
    return (
        df.withColumn("is_focal", op == focal)
        .withColumn("from_focal", F.lag("operatorid").over(w) == focal)
        .withColumn("to_focal", F.lead("operatorid").over(w) == focal)
        .withColumn("exit_to_not_focal", F.col("is_focal") & F.col("from_focal") & ~F.col("to_focal"))
        .withColumn("entrance_from_not_focal", F.col("is_focal") & F.col("to_focal") & ~F.col("from_focal"))
    )


def focal_identify(tr: DataFrame, focal: int = FOCAL_OPERATOR, order: CardOrder | None = None) -> DataFrame:
    """``is_focal``, ``from_focal``, ``to_focal`` and the entrance/exit flags."""
    return resolve(order).apply(tr, lambda d, w: _identify_cols(d, w, focal), halo=1)


def _neighbours(df: DataFrame, w: WindowSpec) -> DataFrame:
    """One window pass: the previous two and the next tap's time, operator,
    operator name and route. Every focal column below is a row expression
    over these, so the whole family costs a single Window operator."""
    cols = {TIME: "t", "operatorid": "op", "participantname": "name", "routename": "route"}
    shifted = []
    for src, short in cols.items():
        shifted += [F.lag(src, 1).over(w).alias(f"_{short}_p1"), F.lag(src, 2).over(w).alias(f"_{short}_p2"),
                    F.lead(src, 1).over(w).alias(f"_{short}_n1")]
    return df.select("*", *shifted)


def _metadata_cols(df: DataFrame, w: WindowSpec, window_min: float, focal: int = FOCAL_OPERATOR,
                   identify: bool = False) -> DataFrame:
    """Connection columns of the focal family (and the flags when ``identify``).

    Stage 1 (per row): gap to the previous tap, the rounded gaps on both
    sides, and the neighbouring operator/route where a connection fits.
    Stage 2: a row whose previous tap was focal takes the previous row's
    stage-1 "from" connection (moving tag-on context to the tag-off row).
    Both stages are written directly on the neighbours of one window pass;
    the previous row's stage-1 values are the same expressions shifted by one.
    """
    c = F.col
    d = _neighbours(df, w)
    op, t = c("operatorid"), c(TIME)
    is_f = op == focal
    from_f, to_f = c("_op_p1") == focal, c("_op_n1") == focal
    exit_nf = is_f & from_f & ~to_f
    entr_nf = is_f & to_f & ~from_f
    timediff = F.abs(minutes_between(c("_t_p1"), t))
    from_time = round2(timediff)
    to_time = round2(F.abs(minutes_between(t, c("_t_n1"))))          # next row's gap
    to_nf = exit_nf & (to_time < window_min)
    from_nf = entr_nf & (from_time < window_min)
    # The previous row's stage-1 "from" values (its next row is this row).
    prev_is_f, prev_from_f = c("_op_p1") == focal, c("_op_p2") == focal
    prev_entr_nf = prev_is_f & is_f & ~prev_from_f
    prev_from_time = round2(F.abs(minutes_between(c("_t_p2"), c("_t_p1"))))
    prev_from_nf = prev_entr_nf & (prev_from_time < window_min)
    flags = [
        is_f.alias("is_focal"), from_f.alias("from_focal"), to_f.alias("to_focal"),
        exit_nf.alias("exit_to_not_focal"), entr_nf.alias("entrance_from_not_focal"),
    ] if identify else []
    out = d.select(
        *df.columns, *flags,
        timediff.alias("timediff"),
        c("_t_p1").alias("time_of_previous"),
        from_time.alias("transfer_from_time"),
        to_time.alias("transfer_to_operator_time"),
        to_nf.alias("transfer_to_not_focal"),
        from_nf.alias("transfer_from_not_focal"),
        F.when(to_nf, c("_name_n1")).alias("transfer_to_operator"),
        F.when(to_nf, c("_route_n1")).alias("transfer_to_route"),
        F.when(from_f, F.when(prev_from_nf, c("_name_p2"))).alias("transfer_from_operator"),
        F.when(from_f, F.when(prev_from_nf, c("_route_p2"))).alias("transfer_from_route"),
        F.when(from_f, prev_from_time).alias("transfer_from_operator_time"),
    )
    return out


def focal_lag_and_lead_metadata(tr: DataFrame, window_min: float = ADJACENT_WINDOW_MIN,
                                order: CardOrder | None = None, focal: int = FOCAL_OPERATOR) -> DataFrame:
    """Gap, previous-tap time and connecting operator/route on both sides.

    Meant for :func:`focal_identify` output (same ``focal``). Thresholds act
    on the rounded gap; ``transfer_from_operator_time`` is masked by
    ``from_focal`` only.
    """
    return resolve(order).apply(tr, lambda d, w: _metadata_cols(d, w, window_min, focal), halo=2)


def as_focal_journeys(tr: DataFrame, focal: int = FOCAL_OPERATOR, window_min: float = ADJACENT_WINDOW_MIN,
                      order: CardOrder | None = None, project: bool = True) -> DataFrame:
    """One row per focal trip (its tag-off row) with connections on each side.

    Only cards with at least one focal tap take part. Keeping or dropping
    whole cards does not change any window value of a kept card, so in the
    plain plan the card test is one more (full-frame) window over the same
    exchange and sort, and the input is scanned once. With split hot cards a
    card spans several window partitions, so the card test is a semi-join.
    """
    order = resolve(order)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return _metadata_cols(d, w, window_min, focal, identify=True)

    if order.hot is None:
        whole = order.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def build_plain(d: DataFrame, w: WindowSpec) -> DataFrame:
            rider = F.max((F.col("operatorid") == focal).cast("int")).over(whole)
            return build(d.withColumn("_rider", rider), w)

        out = order.apply(tr, build_plain, halo=0).where(F.col("_rider") == 1).drop("_rider")
    else:
        # Dependency radius: two taps back, one ahead.
        out = order.apply(cards_using_operator(tr, focal, order.keys, order), build, halo=2)
    out = out.where(F.col("is_focal") & F.col("locationname_destination").isNotNull())
    if not project:
        return out
    # Pass-through columns absent from the input (e.g. tripsequencenumber) are skipped.
    return out.select(*[c for c in FOCAL_JOURNEY_COLUMNS if c in out.columns])


def focal_to_focal(tr: DataFrame, focal: int = FOCAL_OPERATOR, window_min: float = ADJACENT_WINDOW_MIN,
                   order: CardOrder | None = None) -> DataFrame:
    """Focal tag-offs that follow a focal tap, re-windowed over the survivors.

    Cards with a single survivor are dropped; a row stays when its own gap or
    the next row's gap is under ``window_min``.
    """
    order = resolve(order)
    marked = focal_identify(tr, focal, order)
    kept = marked.where(F.col("is_focal") & F.col("from_focal") & (F.col("subtype") == FOCAL_TAG_OFF))

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        # One window pass; the next row's gap is |t(next) - t|, its own gap |t - t(prev)|.
        d = d.select("*", F.lag(TIME).over(w).alias("_t_p1"), F.lead(TIME).over(w).alias("_t_n1"))
        timediff = F.abs(minutes_between("_t_p1", TIME))
        next_gap = F.abs(minutes_between(TIME, "_t_n1"))
        return d.select(
            *[c for c in d.columns if c not in ("_t_p1", "_t_n1")],
            F.col("_t_n1").isNotNull().alias("first_trip"),
            F.col("_t_p1").isNotNull().alias("second_trip"),
            timediff.alias("timediff"),
            F.col("_t_p1").alias("time_of_previous"),
            F.coalesce((next_gap < window_min) | (timediff < window_min), F.lit(False)).alias("_near"),
        )

    out = order.apply(kept, build, halo=1)
    return out.where((F.col("first_trip") | F.col("second_trip")) & F.col("_near")).drop("_near")


def combined_focal_transactions(tr: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """Pair each row with the next one of the same card (six ``second_*`` columns).

    Expects ``timediff`` and ``time_of_previous`` (output of :func:`focal_to_focal`).
    Rows without a next row, or whose next row has no origin, are dropped.
    """
    pairs = {
        "second_originlocation": "originlocation",
        "second_destinationlocation": "destinationlocation",
        "second_locationname_origin": "locationname_origin",
        "second_locationname_destination": "locationname_destination",
        "second_timediff": "timediff",
        "second_time_of_previous": "time_of_previous",
    }

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.select("*", *[F.lead(src).over(w).alias(dst) for dst, src in pairs.items()])

    out = resolve(order).apply(tr, build, halo=1)
    return out.where(F.col("second_originlocation").isNotNull())


def transactions_per_user(tr: DataFrame, keys=("cardid_anony",)) -> DataFrame:
    """Row-preserving ``transaction_count`` per (card, yday) (expects ``yday``)."""
    k1 = [*keys, "yday"]
    return tr.select("*", F.count(F.lit(1)).over(Window.partitionBy(*k1)).alias("transaction_count"))


def focal_transactions_per_user(tr: DataFrame, keys=("cardid_anony",)) -> DataFrame:
    """Row-preserving ``focal_tr_count`` per (card, yday, is_focal) and
    ``tr_count_diff = transaction_count - focal_tr_count`` (expects both
    ``yday``/``is_focal`` and :func:`transactions_per_user`'s column)."""
    k2 = [*keys, "yday", "is_focal"]
    out = tr.select("*", F.count(F.lit(1)).over(Window.partitionBy(*k2)).alias("focal_tr_count"))
    return out.withColumn("tr_count_diff", F.col("transaction_count") - F.col("focal_tr_count"))


def tap_counts(tr: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """Both per-user counts in one pass.

    Expects ``yday`` and ``is_focal``. ``focal_tr_count`` on a non-focal row
    counts the card's non-focal taps that day. In the plain plan the counts
    are unordered windows on the card partitioning the input already has (no
    new exchange). With split hot cards one (card, day) group can be huge, so
    the counts are aggregated map-side and joined back instead (AQE splits a
    skewed join partition); the input is checkpointed first so the three
    branches do not recompute it.
    """
    order = resolve(order)
    keys = list(order.keys)
    if order.hot is None:
        return focal_transactions_per_user(transactions_per_user(tr, keys), keys)
    k1 = [*keys, "yday"]
    k2 = [*k1, "is_focal"]
    one = F.count(F.lit(1))
    tr = materialize(tr)
    day = tr.groupBy(*k1).agg(one.alias("transaction_count"))
    kind = tr.groupBy(*k2).agg(one.alias("focal_tr_count"))
    out = _join_null_safe(_join_null_safe(tr, day, k1), kind, k2)
    return out.withColumn("tr_count_diff", F.col("transaction_count") - F.col("focal_tr_count"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join where null keys match null keys (group-by semantics)."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    cond = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in keys]
    return left.join(renamed, cond, "left").drop(*[f"_r_{c}" for c in keys])
