"""Exact medians of groups of any size, by counting.

``median`` keeps every value of a group in one task. Here a group is only ever
counted: its values' range is cut into bins, the bin that holds the middle rank
becomes the next range, and so on until the range is one value or holds few
enough rows to be put in order. A pass is one aggregate with map-side combine
(at most ``BINS`` rows a group and task), so a group may hold any share of the
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretrail.operators.ordering import null_safe_join
from faretrail.session import materialize

BINS = 1024
#: Rows of a range that are put in order instead of counted again.
FEW = 2048
#: Ranges up to which they are broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 100_000


def _magnitude(v) -> F.Column:
    """A non-decreasing function of a finite double that spreads magnitudes evenly (logarithms of doubles are above -746)."""
    return F.signum(v) * F.when(v == 0, F.lit(0.0)).otherwise(F.log(F.abs(v)) + 746.0)


def _bin(v, lo, hi) -> F.Column:
    """The bin of a value in its range; infinities and NaN have bins of their own.

    Ranges over several magnitudes are cut by magnitude, narrow ones evenly (in
    halves, so that no difference overflows). A range of one finite value has
    one bin for it.
    """
    wide = (hi / 2 - lo / 2) > F.greatest(F.abs(lo), F.abs(hi)) / 4
    even = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    by_size = F.try_divide(_magnitude(v) - _magnitude(lo), _magnitude(hi) - _magnitude(lo))
    finite = F.floor(F.when(wide, by_size).otherwise(even) * BINS)
    return (F.when(F.isnan(v), F.lit(BINS + 1)).when(v == float("inf"), F.lit(BINS)).when(v == float("-inf"), F.lit(-1))
            .otherwise(F.greatest(F.lit(0), F.least(finite, F.lit(BINS - 1)))).cast("int"))


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", bins_below: int = FEW) -> DataFrame:
    """``keys`` and the median of ``value`` (a double) of every group, as ``median`` gives it.

    Nulls are left out, a group of nulls alone has a null median; the median of
    an even number of values is the mean of the middle two. NaN counts as larger
    than every number. Null keys are groups like others; an empty table gives no
    rows. ``bins_below``: ranges of at most so many rows are put in order.
    """
    keys = list(keys)
    rows = materialize(df.select(*keys, F.col(value).cast("double").alias("_v")))
    limits = [F.min(F.when(~F.isnan("_v") & (F.abs("_v") != float("inf")), F.col("_v"))).alias("_lo"),
              F.max(F.when(~F.isnan("_v") & (F.abs("_v") != float("inf")), F.col("_v"))).alias("_hi")]
    groups = materialize(rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *limits))
    # the lower and the upper middle, each with its rank in its range
    sides = F.array(*[F.struct(F.lit(s).alias("side"), r.cast("long").alias("rank")) for s, r in
                      enumerate((F.expr("(_n - 1) div 2"), F.expr("_n div 2")))])
    ranges = materialize(groups.where("_n > 0").withColumn("_s", F.explode(sides)).select(
        *keys, F.col("_s.side").alias("_side"), F.col("_s.rank").alias("_rank"), "_n", "_least", "_most", "_lo", "_hi"))
    of = [*keys, "_side"]
    inside = (F.col("_v") >= F.col("_least")) & (F.col("_v") <= F.col("_most"))
    settled = (F.col("_least") == F.col("_most")) | (F.col("_n") <= bins_below)
    while not (open_ := ranges.where(~settled)).isEmpty():
        found = null_safe_join(rows, _few(open_), keys, "inner").where(inside)
        bins = found.groupBy(*of, "_rank", _bin(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *limits)
        upto = F.sum("_n").over(Window.partitionBy(*of).orderBy("_bin"))
        chosen = bins.withColumn("_upto", upto).where("_upto - _n <= _rank AND _rank < _upto").withColumn("_rank", F.expr("_rank - _upto + _n"))
        ranges = materialize(ranges.where(settled).unionByName(chosen.select(ranges.columns)))
    one = ranges.where("_least = _most").select(*of, F.col("_least").alias("_v"))
    few = null_safe_join(rows, _few(ranges.where("_least != _most")), keys, "inner").where(inside)
    few = few.groupBy(*of, "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all")).select(
        *of, F.element_at("_all", (F.col("_rank") + 1).cast("int")).alias("_v"))
    ends = one.unionByName(few).groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    middle = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * 0.5 + F.col("_b") * 0.5)
    return null_safe_join(groups.select(*keys), ends.select(*keys, middle.alias(name)), keys, "left")


def _few(ranges: DataFrame) -> DataFrame:
    return F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
