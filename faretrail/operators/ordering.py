"""Card-ordered windows, with an exact split for hot cards.

Every ordered operator looks at one card's taps in time order. The plain plan
is one hash exchange on the card and one sort; stacked operators built on the
same window spec reuse both.

A single card can still be hot (a sentinel or shared card may hold a large
share of all rows), and a window cannot be split by AQE. :class:`CardOrder`
therefore supports an exact split:

* hot cards are those with more than ``segment_rows`` taps; there are at most
  ``total_rows / segment_rows`` of them, so the hot list has a proven size
  bound and is broadcast;
* the taps of hot cards alone are dealt by ranges of (card, time, sequence) and
  sorted, and each range is cut after every ``segment_rows`` rows. A segment is
  thus a run of ranks, not of time: it never holds more than ``segment_rows``
  taps, also where millions of them share a second or an instant. The window
  key becomes ``(card, segment)``;
* each segment receives a *halo*: copies of the ``halo`` taps right before
  and after it, taken from the first/last ``halo`` rows of every segment (a
  bounded table). Window expressions whose dependency radius is at most
  ``halo`` are then exact on the segment's own rows, and halo copies are
  dropped afterwards.

Cold cards keep segment 0 and get no halo rows, so they go through the same
single exchange as in the plain plan. Ranges come from a sample, so segments are
written once before more than one branch reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faretrail.schema import CARD, SEQ, TIME
from faretrail.session import materialize, write_stage

SEGMENT = "_segment"
HALO = "_halo"
_HOT_N = "_hot_n"
_AT = "_at"
#: Rows up to which the hot list is broadcast; a longer one is joined by a shuffle.
HOT_BROADCAST_ROWS = 200_000
#: Ranges of hot taps for every segment's worth of them, so that a range which the sample makes too large still fits a task.
RANGES_A_SEGMENT = 2
#: Ranges are tasks; beyond this many each holds more rows, its segments are no longer.
MOST_RANGES = 100_000


@dataclass(frozen=True)
class CardOrder:
    """Partition keys, order keys and (optionally) the hot-card split."""

    keys: Sequence[str] = (CARD,)
    order: Sequence[str] = (TIME, SEQ)
    hot: DataFrame | None = field(default=None, compare=False)
    segment_rows: int | None = None
    # Broadcast the hot list only when its measured size is under this many
    # rows; otherwise the segment tagging is a shuffle join.
    broadcast_hot: bool = True
    #: Taps of all hot cards together; counted when first needed.
    hot_rows: int | None = field(default=None, compare=False)

    # -- construction -------------------------------------------------------
    @staticmethod
    def plain(keys: Sequence[str] = (CARD,)) -> "CardOrder":
        return CardOrder(keys=tuple(keys))

    @staticmethod
    def detect(df: DataFrame, segment_rows: int = 2_000_000,
               keys: Sequence[str] = (CARD,), order: Sequence[str] = (TIME, SEQ)) -> "CardOrder":
        """The split of these rows, nothing run yet (partial aggregation, one row per card).

        At most ``count(df) / segment_rows`` rows survive the filter, which is
        what makes broadcasting the hot list safe at any input size.
        """
        hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_HOT_N)).where(F.col(_HOT_N) > F.lit(segment_rows))
        return CardOrder(keys=tuple(keys), order=tuple(order), hot=hot, segment_rows=segment_rows)

    @staticmethod
    def settle(df: DataFrame, segment_rows: int | None = 2_000_000,
               keys: Sequence[str] = (CARD,), order: Sequence[str] = (TIME, SEQ)) -> "CardOrder":
        """Find hot cards: the plain order when there are none, else the split with its written hot list.

        One aggregate over the keys tells whether there are any; only then is
        the list itself written, and broadcast later if it is short.
        """
        if segment_rows is None:
            return CardOrder(keys=tuple(keys), order=tuple(order))
        found = CardOrder.detect(df, segment_rows, keys, order)
        size = found.hot.agg(F.count(F.lit(1)).alias("cards"), F.sum(_HOT_N).alias("rows")).first()
        if not size.cards:
            return CardOrder(keys=tuple(keys), order=tuple(order))
        return replace(found, hot=materialize(found.hot), hot_rows=size.rows,
                       broadcast_hot=size.cards <= HOT_BROADCAST_ROWS)

    def renamed(self, names: dict[str, str]) -> "CardOrder":
        """The same split for a table whose key columns have other names."""
        hot = None if self.hot is None else self.hot.withColumnsRenamed(names)
        return replace(self, keys=tuple(names.get(k, k) for k in self.keys), hot=hot)

    # -- windows ------------------------------------------------------------
    def _order_cols(self, descending: bool = False):
        if descending:
            return [F.col(c).desc_nulls_first() for c in self.order]
        return [F.col(c).asc_nulls_last() for c in self.order]

    def window(self) -> WindowSpec:
        """The window every operator builds on (card, segment when split)."""
        keys = list(self.keys) + ([SEGMENT] if self.hot is not None else [])
        return Window.partitionBy(*keys).orderBy(*self._order_cols())

    def segments(self, df: DataFrame, order: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
        """``df`` with a ``_segment`` column: runs of at most ``rows`` (``segment_rows``) rows
        of a hot card in ``order``, numbered upwards; 0 for every row of a cold card."""
        if self.hot is None:
            return df.withColumn(SEGMENT, F.lit(0).cast("long"))
        cold, hot = self._parted(df)
        by = None if order is None else [F.col(c).asc_nulls_first() for c in (*self.keys, *order)]  # as structs are ordered
        return cold.unionByName(self._cut(hot, by, rows)).drop(_HOT_N, HALO)

    # -- application ----------------------------------------------------------
    def apply(self, df: DataFrame, build: Callable[[DataFrame, WindowSpec], DataFrame],
              halo: int = 1) -> DataFrame:
        """Run ``build(df, window)`` exactly, splitting hot cards if configured.

        ``build`` may add columns (window or row expressions) but must not
        filter rows; ``halo`` is its dependency radius in rows.
        """
        if self.hot is None:
            return build(df, self.window())
        cols = df.columns
        cold, hot = self._parted(df)
        hot = self._cut(hot)
        if halo > 0:
            # Rows and halo edges both read the segments: write them once, and
            # read them back as two independent relations.
            spark = df.sparkSession
            path = write_stage(hot)
            hot = spark.read.parquet(path).unionByName(self._halo_rows(spark.read.parquet(path), halo))
        out = build(cold.unionByName(hot), self.window())
        helpers = (SEGMENT, HALO, _HOT_N)
        return out.where(~F.col(HALO)).select(
            *cols, *[c for c in out.columns if c not in cols and c not in helpers]
        )

    def _parted(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of cold cards (in segment 0) and of hot cards, both from one written copy."""
        hot = F.broadcast(self.hot) if self.broadcast_hot else self.hot
        path = write_stage(null_safe_join(df, hot, self.keys, "left").select(*df.columns, _HOT_N))
        rows = df.sparkSession.read.parquet(path)
        cold = rows.where(F.col(_HOT_N).isNull()).withColumns({SEGMENT: F.lit(0).cast("long"), HALO: F.lit(False)})
        return cold, rows.where(F.col(_HOT_N).isNotNull())

    def _cut(self, hot: DataFrame, by: list | None = None, rows: int | None = None) -> DataFrame:
        """Rows of hot cards with their segment: ranges of (card, order), cut after every ``rows`` rows.

        Row numbers inside a sorted range are the low 33 bits of Spark's
        increasing ids, the range is the rest.
        """
        rows = rows or self.segment_rows
        total = self.hot_rows
        if total is None:
            total = self.hot.agg(F.sum(_HOT_N)).first()[0] or 0
        by = by or [F.col(c).asc_nulls_last() for c in (*self.keys, *self.order)]
        ranges = max(1, -(-RANGES_A_SEGMENT * total // rows))
        dealt = hot.repartitionByRange(min(ranges, MOST_RANGES), *by).sortWithinPartitions(*by)
        at = F.col(_AT)
        segment = F.shiftleft(F.shiftrightunsigned(at, 33), 33) + F.floor(at.bitwiseAND((1 << 33) - 1) / F.lit(rows)).cast("long") + 1
        return (dealt.withColumn(_AT, F.monotonically_increasing_id())
                .withColumns({SEGMENT: segment.cast("long"), HALO: F.lit(False)}).drop(_AT))

    def _segmented(self, df: DataFrame) -> DataFrame:
        """All rows tagged with their segment (0 for cold cards)."""
        cold, hot = self._parted(df)
        return cold.unionByName(self._cut(hot))

    def _halo_rows(self, tagged: DataFrame, halo: int) -> DataFrame:
        hot_rows = tagged.where(F.col(_HOT_N).isNotNull())
        w_seg = Window.partitionBy(*self.keys, SEGMENT)
        first = F.row_number().over(w_seg.orderBy(*self._order_cols()))
        last = F.row_number().over(w_seg.orderBy(*self._order_cols(descending=True)))
        edges = hot_rows.select("*", first.alias("_f"), last.alias("_l")).where(
            (F.col("_f") <= halo) | (F.col("_l") <= halo)
        ).drop("_f", "_l")
        # Edges hold at most 2*halo rows per segment: a bounded window per card.
        w_card = Window.partitionBy(*self.keys).orderBy(*self._order_cols())
        seg = F.col(SEGMENT)
        near = [F.lead(SEGMENT, j).over(w_card).alias(f"_a{j}") for j in range(1, halo + 1)]
        near += [F.lag(SEGMENT, j).over(w_card).alias(f"_b{j}") for j in range(1, halo + 1)]
        names = [f"_a{j}" for j in range(1, halo + 1)] + [f"_b{j}" for j in range(1, halo + 1)]
        edges = edges.select("*", *near)
        targets = F.array_distinct(F.filter(F.array(*names), lambda s: s.isNotNull() & (s != seg)))
        return edges.select(
            *[c for c in tagged.columns if c not in (SEGMENT, HALO)],
            F.explode(targets).alias(SEGMENT),
            F.lit(True).alias(HALO),
        ).select(*tagged.columns)


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


PLAIN = CardOrder()


def resolve(order: CardOrder | None) -> CardOrder:
    return PLAIN if order is None else order
