"""Gaps between rides and numbered multi-ride journeys.

``journey_id`` numbers journeys densely over the whole table in
``(card, time)`` order. A global running sum would force every row through
one task, so the number is assembled from bounded pieces instead.

Plain plan: rows are hash-partitioned once by an order-preserving card-id
bucket (the first characters of the id). That exchange also clusters each
card, so the per-card lags, the running count of journey starts over the
bucket in (card, time) order, and the legs count share it. The journey number
is the bucket's offset (prefix sum over at most 16**prefix bucket totals,
broadcast after a size check) plus the number inside the bucket.

Hot cards (split into time segments): running counts per (card, segment),
shifted by the card's earlier segments, and card offsets from a two-level
prefix sum over per-card totals; legs are aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faretrail.functions.scalars import minutes_between
from faretrail.operators.ordering import SEGMENT, CardOrder, null_safe_join, resolve
from faretrail.operators.rides import as_rides
from faretrail.schema import JOURNEY_GAP_MIN, TIME
from faretrail.session import materialize

BUCKET_PREFIX = 4  # 16**4 buckets for hex card ids


def _transfer_time_cols(df: DataFrame, w: WindowSpec) -> DataFrame:
    return (
        df.withColumn("previous_time", F.lag(TIME).over(w))
        .withColumn("transfer_time", minutes_between("previous_time", TIME))
        .withColumn("previous_participant", F.lag("participantname").over(w))
    )


def add_transfer_time(tr: DataFrame, order: CardOrder | None = None, rides: bool = False) -> DataFrame:
    """Rides with ``previous_time``, ``transfer_time`` (minutes) and ``previous_participant``.

    ``rides``: the input holds rides, taken as they are, not taps.
    """
    order = resolve(order)
    return order.apply(tr if rides else as_rides(tr, order), _transfer_time_cols, halo=1)


def _key_offsets(starts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Exclusive prefix sum of journey totals per key tuple, in the order of card and further keys."""
    card = keys[0]
    # One row per key tuple, used twice (bucket totals, offsets inside buckets).
    per_card = materialize(starts.groupBy(*keys).agg(F.sum("_new").alias("_n")).withColumn("_bucket", _bucket(card)))
    per_bucket = per_card.groupBy("_bucket").agg(F.sum("_n").alias("_bn"))
    # One row per bucket: the only unpartitioned window, bounded by the bucket count.
    wb = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("_bucket", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_boff"))
    wc = Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_last() for k in keys]).rowsBetween(
        Window.unboundedPreceding, -1)
    per_card = per_card.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_coff"))
    return per_card.join(per_bucket, "_bucket").select(*keys, (F.col("_boff") + F.col("_coff")).alias("_card_off"))


def _bucket(card: str, prefix: int = BUCKET_PREFIX) -> F.Column:
    """Order-preserving bucket of a card id (its first characters; null last)."""
    return F.coalesce(F.substring(F.col(card), 1, prefix), F.lit("\uffff"))


def _flag_new(df: DataFrame, time: float) -> DataFrame:
    flag = F.coalesce(F.col("transfer_time") < F.lit(time), F.lit(False))
    return df.withColumn("is_transfer", flag).withColumn("_new", 1 - F.col("is_transfer").cast("int"))


def add_journey_id(tr: DataFrame, time: float = JOURNEY_GAP_MIN, order: CardOrder | None = None,
                   materialize_rows: bool = True, bucket_prefix: int = BUCKET_PREFIX,
                   keep: list[str] | None = None, rides: bool = False) -> DataFrame:
    """Rides with ``is_transfer`` (gap strictly below ``time``), ``journey_id`` and ``num_legs``.

    ``materialize_rows`` checkpoints the numbered rides (one eager job) so the
    rows and the offset table built from them share one computation.
    ``bucket_prefix`` sets the number of card-id buckets (16**prefix for hex
    ids): larger for bigger tables, so one bucket stays a modest window group.
    ``keep`` limits the ride columns carried through (column pruning cannot
    pass a checkpoint, so only these are written); default: all. ``rides``: the
    input holds rides, taken as they are, not taps.
    """
    order = resolve(order)
    if order.hot is None and len(order.keys) == 1:
        return _journeys_by_bucket(tr, time, order, materialize_rows, bucket_prefix, keep, rides)
    timed = _keep(add_transfer_time(tr, order, rides), keep, order)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return _flag_new(df, time).withColumn("_local", F.sum("_new").over(running))

    if order.hot is None:
        seq = order.apply(timed, build, halo=0).withColumn("_seq", F.col("_local"))
        seq = seq.withColumn("num_legs", F.count(F.lit(1)).over(Window.partitionBy(*order.keys, "_seq")))
    else:
        seq = _segment_sequence(order, timed, build)
    if materialize_rows:
        seq = materialize(seq)
    if order.hot is not None:
        # A journey of a hot card can be huge: aggregate map-side, join back
        # (AQE splits a skewed join partition).
        legs = seq.groupBy(*order.keys, "_seq").agg(F.count(F.lit(1)).alias("num_legs"))
        seq = null_safe_join(seq, legs, [*order.keys, "_seq"], "left")
    out = null_safe_join(seq, _key_offsets(seq, order.keys), order.keys, "left")
    return out.select(
        *timed.columns, "is_transfer",
        (F.coalesce(F.col("_card_off"), F.lit(0)) + F.col("_seq")).alias("journey_id"),
        "num_legs",
    )


OFFSET_BROADCAST_ROWS = 1_000_000


def _keep(timed: DataFrame, keep: list[str] | None, order: CardOrder, extra=()) -> DataFrame:
    if keep is None:
        return timed
    need = [*order.keys, *order.order, "transfer_time", *extra]
    return timed.select(*dict.fromkeys([*need, *keep]))


def _journeys_by_bucket(tr: DataFrame, time: float, order: CardOrder, materialize_rows: bool,
                        bucket_prefix: int = BUCKET_PREFIX, keep: list[str] | None = None, rides: bool = False) -> DataFrame:
    """Plain plan: one exchange on an order-preserving card-id bucket.

    Hash partitioning by the bucket also clusters every card, so the per-card
    lags, the running count of journey starts over the whole bucket (in card,
    time order) and the legs count all run on that single exchange and sort.
    A journey's number is then the bucket's offset (prefix sum over the bucket
    totals, at most 16**BUCKET_PREFIX rows for hex ids) plus its number inside
    the bucket; the offset table is broadcast after its size is checked.
    """
    card = order.keys[0]
    bucketed = tr.withColumn("_bucket", _bucket(card, bucket_prefix)).repartition("_bucket")
    border = CardOrder(keys=("_bucket", card), order=order.order)
    timed = _keep(add_transfer_time(bucketed, border, rides), keep, order, extra=("_bucket",))
    # Card order nulls-first matches the sort the per-card windows already did
    # (no second sort); null cards sit alone in the last bucket anyway.
    in_bucket = Window.partitionBy("_bucket").orderBy(
        F.col(card).asc_nulls_first(), *[F.col(c).asc_nulls_last() for c in order.order]
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = _flag_new(timed, time).withColumn("_seq", F.sum("_new").over(in_bucket))
    seq = seq.withColumn("num_legs", F.count(F.lit(1)).over(Window.partitionBy("_bucket", card, "_seq")))
    if materialize_rows:
        seq = materialize(seq)
    totals = seq.groupBy("_bucket").agg(F.sum("_new").alias("_bn"))
    # One row per bucket: the only unpartitioned window, bounded by the bucket count.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("_bucket", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_boff")))
    if offsets.count() <= OFFSET_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    out = seq.join(offsets, "_bucket", "left")
    return out.select(
        *[c for c in timed.columns if c != "_bucket"], "is_transfer",
        (F.coalesce(F.col("_boff"), F.lit(0)) + F.col("_seq")).alias("journey_id"),
        "num_legs",
    )


def _segment_sequence(order: CardOrder, timed: DataFrame, build) -> DataFrame:
    """Running journey count per card when hot cards are split into segments.

    The running sum is taken per (card, segment); each segment is then shifted
    by the journey starts of the card's earlier segments (a table with one row
    per hot-card segment, bounded by the hot list).
    """
    tagged = order._segmented(timed)
    # The counted rows feed the segment totals and the rows themselves.
    local = materialize(build(tagged, order.window()))
    hot_segs = (
        local.where(F.col("_hot_n").isNotNull())
        .groupBy(*order.keys, SEGMENT).agg(F.sum("_new").alias("_sn"))
    )
    ws = Window.partitionBy(*order.keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    seg_off = hot_segs.select(*order.keys, SEGMENT, F.coalesce(F.sum("_sn").over(ws), F.lit(0)).alias("_soff"))
    out = null_safe_join(local, seg_off, [*order.keys, SEGMENT], "left")
    return out.withColumn("_seq", F.col("_local") + F.coalesce(F.col("_soff"), F.lit(0))).drop(
        "_soff", "_hot_n", SEGMENT, "_halo")
