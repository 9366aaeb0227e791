"""Analyses over operator outputs: origin-destination tables, top transfer
movements, product usage, hour histograms, and the expanded transfer database
with its share, median and total tables.

Every report is an aggregation (partial + final) over an operator output.
Exact medians keep all values of a group; the groups here are (agency pair,
year) or calendar cells over day-level rows, so a group holds at most a few
hundred values whatever the tap volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretrail.functions.scalars import month_label, weekday_name
from faretrail.operators.sequences import circadian_date, day_id_columns

DAY_KEYS = ["Year", "Month", "CircadianDayOfWeek", "RandomWeekID"]


def od_matrix(journeys: DataFrame) -> DataFrame:
    """Focal trips per (origin station, destination station)."""
    return journeys.groupBy("locationname_origin", "locationname_destination").agg(
        F.count(F.lit(1)).alias("trips"))


def top_movements(journeys: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent (from operator/route, to operator/route) connections
    around focal trips; ties broken by the keys (nulls last)."""
    keys = ["transfer_from_operator", "transfer_from_route", "transfer_to_operator", "transfer_to_route"]
    moved = journeys.where(F.col("transfer_from_operator").isNotNull() | F.col("transfer_to_operator").isNotNull())
    counts = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("trips"))
    return counts.orderBy(F.col("trips").desc(), *[F.col(c).asc_nulls_last() for c in keys]).limit(k)


def product_usage(rides: DataFrame, k: int | None = 6, weighting: str = "ride") -> DataFrame:
    """Mean rides per card for each product, top ``k`` by the mean.

    ``weighting='ride'`` averages the per-(card, product) ride count over ride
    rows (sum n^2 / sum n), which is what attaching the count to every ride and
    then averaging gives; ``'card'`` averages over cards.
    """
    per_card = rides.groupBy("cardid_anony", "product_description").agg(F.count(F.lit(1)).alias("_n"))
    if weighting == "ride":
        mean = (F.sum(F.col("_n") * F.col("_n")).cast("double") / F.sum("_n").cast("double"))
    elif weighting == "card":
        mean = F.sum("_n").cast("double") / F.count(F.lit(1)).cast("double")
    else:
        raise ValueError("weighting must be 'ride' or 'card'")
    out = per_card.groupBy("product_description").agg(mean.alias("mean_rides"))
    if k is None:
        return out
    return out.orderBy(F.col("mean_rides").desc(), F.col("product_description").asc_nulls_last()).limit(k)


def hour_histogram(df: DataFrame, ts: str, source: str) -> DataFrame:
    """Row counts by hour of ``ts`` (null times left out), labelled ``source``."""
    h = F.hour(F.col(ts))
    return df.where(F.col(ts).isNotNull()).groupBy(h.alias("hour")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "hour", "n")


def with_circadian_day(rides: DataFrame, ts: str = "transaction_time") -> DataFrame:
    return rides.select("*", *day_id_columns(circadian_date(ts)))


def transfer_database(classified: DataFrame, sampling_rate: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Per (day, from agency, to agency): sampled and estimated transfers and the
    two agencies' sampled and estimated ride counts.

    ``classified`` is the output of ``classify_rule_transfers``. Pairs with no
    transfer are not emitted, nor pairs whose from- or to-agency has no ride
    that day. Estimates are sampled counts divided by the sampling rate,
    rounded to whole rides. ``by``: further columns that keep days apart.

    One pass over the rides counts rides and transfers of each (day, previous
    agency, agency); agency rows (rides per day and agency) are sums of these
    few. Two windows over that small result attach the to-agency total
    (partition by the agency) and the from-agency total (partition by the
    previous agency) to each pair row.
    """
    day_keys = [*by, *DAY_KEYS]
    days = with_circadian_day(classified).drop("DayID")
    agency_set = [*day_keys, "participantname"]
    pair_set = [*day_keys, "previous_participant", "participantname"]
    counts = days.groupBy(*pair_set).agg(
        F.count(F.lit(1)).alias("_rides"),
        F.count(F.when(F.col("is_rule_transfer"), F.lit(1))).alias("_transfers"),
    )
    counts = counts.groupingSets([agency_set, pair_set], *pair_set).agg(
        F.grouping("previous_participant").alias("_agency_row"),
        F.sum("_rides").alias("_rides"),
        F.sum("_transfers").alias("_transfers"),
    )
    is_agency = F.col("_agency_row") == 1
    agency_rides = F.sum(F.when(is_agency, F.col("_rides")))
    from_key = F.when(is_agency, F.col("participantname")).otherwise(F.col("previous_participant"))
    counts = counts.withColumn("_from_key", from_key)
    with_totals = counts.select(
        "*",
        agency_rides.over(Window.partitionBy(*day_keys, "participantname")).alias("_to_rides"),
        agency_rides.over(Window.partitionBy(*day_keys, "_from_key")).alias("_from_rides"),
    )
    pairs = with_totals.where(
        ~is_agency & (F.col("_transfers") > 0)
        & F.col("_to_rides").isNotNull() & F.col("_from_rides").isNotNull()
    )

    def est(c):
        return F.round(F.col(c) / F.lit(float(sampling_rate))).cast("long")

    return pairs.select(
        *day_keys,
        F.col("participantname").alias("to_AgencyName"),
        F.col("previous_participant").alias("from_AgencyName"),
        F.col("_transfers").alias("sampled_transfers"),
        F.col("_from_rides").alias("from_Agency_Sampled_Transactions"),
        F.col("_to_rides").alias("to_Agency_Sampled_Transactions"),
    ).select(
        "*",
        est("sampled_transfers").alias("estimated_transfers"),
        est("from_Agency_Sampled_Transactions").alias("estimated_from_agency_transactions"),
        est("to_Agency_Sampled_Transactions").alias("estimated_to_agency_transactions"),
    )


def transfer_shares(db: DataFrame) -> DataFrame:
    """Shares of estimated transfers in each agency's estimated rides, with
    month and weekday labels. A zero denominator gives null."""
    return db.select(
        "*",
        F.try_divide(F.col("estimated_transfers").cast("double"),
                     F.col("estimated_from_agency_transactions").cast("double")).alias("from_share"),
        F.try_divide(F.col("estimated_transfers").cast("double"),
                     F.col("estimated_to_agency_transactions").cast("double")).alias("to_share"),
        month_label("Month").alias("MonthName"),
        weekday_name("CircadianDayOfWeek").alias("DayName"),
    )


def median_from_share(shares: DataFrame, from_agency: str) -> DataFrame:
    """Median from-share by to-agency for one from-agency."""
    return shares.where(F.col("from_AgencyName") == from_agency).groupBy("to_AgencyName").agg(
        F.median("from_share").alias("median_from_share"))


def share_by_from(shares: DataFrame) -> DataFrame:
    """Per (from, to, year): median transfers, from-agency rides and from-share."""
    return shares.groupBy("from_AgencyName", "to_AgencyName", "Year").agg(
        F.median("estimated_transfers").alias("median_transfers"),
        F.median("estimated_from_agency_transactions").alias("median_from_transactions"),
        F.median("from_share").alias("median_from_share"),
    )


def share_by_to(shares: DataFrame) -> DataFrame:
    """Per (from, to, year): median transfers, to-agency rides and to-share."""
    return shares.groupBy("from_AgencyName", "to_AgencyName", "Year").agg(
        F.median("estimated_transfers").alias("median_transfers"),
        F.median("estimated_to_agency_transactions").alias("median_to_transactions"),
        F.median("to_share").alias("median_to_share"),
    )


def agency_transactions(db: DataFrame) -> DataFrame:
    """Median estimated rides of each from-agency per (year, month, weekday), long format."""
    return db.groupBy("Year", "Month", "CircadianDayOfWeek", "from_AgencyName").agg(
        F.median("estimated_from_agency_transactions").alias("median_from_transactions"))


def observed_days(db: DataFrame) -> DataFrame:
    """Distinct sampled weeks per (year, month, weekday)."""
    return db.groupBy("Year", "Month", "CircadianDayOfWeek").agg(
        F.count_distinct("RandomWeekID").alias("observed_weeks"))


def transfers_with_totals(db: DataFrame) -> DataFrame:
    """Median and sample standard deviation of estimated transfers per
    (from, to, year) plus a total row per (from, to) over all years
    (``is_total`` marks it; its ``Year`` is null)."""
    keys = ["from_AgencyName", "to_AgencyName", "Year"]
    return db.groupingSets([keys, keys[:2]], *keys).agg(
        F.grouping("Year").cast("boolean").alias("is_total"),
        F.median("estimated_transfers").alias("median_transfers"),
        exact_stddev_samp("estimated_transfers").alias("sd_transfers"),
    )


def pivoted(report: DataFrame, heading: str, values: list[str], headings: list | None = None) -> DataFrame:
    """The wide form of a report: a column for each heading, and one a value where there are several.

    Rows are told apart by the report's other columns. Columns are named by the
    heading, followed by the value's name where several values are asked for; a
    cell without a row is null. ``headings`` fixes the columns and their order,
    and a row under any other heading, or none, is an error, so nothing is left
    out silently. Without it Spark reads the headings first (at most
    ``spark.sql.pivotMaxValues``), for which the report is computed once more.
    """
    keys = [c for c in report.columns if c != heading and c not in values]
    if headings is not None:
        known = F.coalesce(F.col(heading).isin(*headings), F.lit(False))
        text = F.concat(F.lit(f"not among the headings of {heading}: "), F.coalesce(F.col(heading).cast("string"), F.lit("null")))
        report = report.withColumn(heading, F.when(known, F.col(heading)).otherwise(F.raise_error(text).cast(report.schema[heading].dataType)))
    return report.groupBy(*keys).pivot(heading, headings).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def exact_stddev_samp(c: str) -> F.Column:
    """Sample standard deviation of an integer column from exact integer moments.

    ``sqrt((n*sum(x^2) - sum(x)^2) / (n*(n-1)))`` with the sums in
    38-digit decimals: the result does not depend on partitioning or merge
    order, does not overflow while n * sum(x^2) stays below 10**38, and is null
    for fewer than two values.
    """
    x = F.col(c).cast("long")
    n = F.count(x)
    wide = x.cast("decimal(19,0)")
    total = F.sum(wide).cast("decimal(38,0)")
    num = (n.cast("decimal(38,0)") * F.sum((wide * wide).cast("decimal(38,0)")).cast("decimal(38,0)") - total * total).cast("double")
    return F.when(n > 1, F.sqrt(num / (n * (n - 1)).cast("double")))
