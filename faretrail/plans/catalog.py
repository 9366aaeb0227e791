"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

All of them read the driver tables through :mod:`faretrail.sources` and run
over the whole tables. Parameters are fixed here (window 120 minutes, service
day 2024-01-10, 5 sampled cards, ...) so that the DuckDB oracle in
:mod:`faretrail.plans.oracle` computes the same thing.
"""

from __future__ import annotations

import uuid
from functools import cached_property, reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrail import sources as src
from faretrail.functions.timecols import nicetime, spread_time_column
from faretrail.operators import (
    CardOrder, add_journey_id, add_transfer_time, as_focal_journeys, as_rides, cards_using_operator,
    classify_rule_transfers, combined_focal_transactions, create_transfer_df, day_of_transactions,
    descriptive_tables, exact_medians, extract_sequence_by_date, extract_sequence_for_random_week, fares_for_day, focal_identify,
    focal_lag_and_lead_metadata, focal_to_focal, get_product_description, identify_transfer_for_time,
    make_human_readable, merge_samples, sample_day_of_transactions, sample_user_transactions, sequences_of_sampled_trips, tap_counts,
    write_day_table, write_sample_state,
)
from faretrail.plans import reports
from faretrail.session import checkpoint_dir

TRANSFER_MINS = 120
JOURNEY_GAP = 60
SERVICE_DATE = "2024-01-10"
SAMPLE_CARDS = 5
SAMPLE_SEED = 0
TOP_K = 10
PRODUCT_TOP = 6
SAMPLING_RATE = 0.5
CHART_AGENCY = "NATION_4"
#: Years of the taps, the headings of the wide reports; a tap of another year makes these fail.
REPORT_YEARS = [2023, 2024]
SEGMENT_ROWS = 2_000_000

KEY = ["cardid_anony", "sequencenumber", "transaction_time"]


class Base:
    """Lazy base plans of one data directory (scans, fixture mapping, lookups,
    enrichment) and the hot-card decision.

    Made anew for every run, so a run always sees the files as they are: a
    DataFrame keeps the file list of its scan, and hot cards come with the data.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, segment_rows: int | None):
        self.spark, self.sf_dir, self.segment_rows = spark, sf_dir, segment_rows

    @cached_property
    def raw(self) -> DataFrame:
        return src.raw_transactions(src.read_table(self.spark, self.sf_dir, "events"))

    @cached_property
    def taps(self) -> DataFrame:
        return src.day_taps(self.raw)

    @cached_property
    def nation(self) -> DataFrame:
        return src.read_table(self.spark, self.sf_dir, "nation")

    @cached_property
    def part(self) -> DataFrame:
        return src.read_table(self.spark, self.sf_dir, "part")

    @cached_property
    def dims(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return (src.participants_from(self.nation), src.routes_from(self.part), src.locations_from(self.part))

    @cached_property
    def enriched(self) -> DataFrame:
        return make_human_readable(self.taps, *self.dims)

    @cached_property
    def order(self) -> CardOrder:
        """Hot-card split, detected once on the taps.

        When no card exceeds ``segment_rows`` (the usual case) the plain
        one-exchange plan is used; otherwise hot cards are split exactly.
        """
        return self.order_of(self.taps)

    def order_of(self, taps: DataFrame) -> CardOrder:
        """Hot-card split of these taps."""
        return CardOrder.settle(taps.select("cardid_anony", "transaction_time"), self.segment_rows)


class Inputs:
    """Frames of one query run: the shared base plans plus per-query derived
    frames (intermediates checkpointed by one query are not reused by another)."""

    def __init__(self, spark: SparkSession, sf_dir: str, segment_rows: int | None = SEGMENT_ROWS,
                 base: Base | None = None):
        self.spark, self.sf_dir, self.segment_rows = spark, sf_dir, segment_rows
        self.base = base or Base(spark, sf_dir, segment_rows)

    raw = property(lambda self: self.base.raw)
    taps = property(lambda self: self.base.taps)
    nation = property(lambda self: self.base.nation)
    part = property(lambda self: self.base.part)
    dims = property(lambda self: self.base.dims)
    enriched = property(lambda self: self.base.enriched)

    @cached_property
    def order(self) -> CardOrder:
        return self.base.order

    @cached_property
    def rides_enriched(self) -> DataFrame:
        return as_rides(self.enriched, self.order)

    @cached_property
    def focal_journeys(self) -> DataFrame:
        return as_focal_journeys(self.enriched, order=self.order)

    @cached_property
    def rule_classified(self) -> DataFrame:
        rules = src.transfer_rules_from(self.nation)
        return classify_rule_transfers(self.enriched, rules, self.order)

    @cached_property
    def transfer_db(self) -> DataFrame:
        return reports.transfer_database(self.rule_classified, SAMPLING_RATE)

    @cached_property
    def shares(self) -> DataFrame:
        return reports.transfer_shares(self.transfer_db)

    def products(self) -> tuple[DataFrame, DataFrame]:
        return (src.contract_product_map_from(self.nation), src.products_from(self.nation))


# ---------------------------------------------------------------------------
# One function per registered query.

def q_transfer_matrix(i: Inputs) -> DataFrame:
    return create_transfer_df(i.enriched, TRANSFER_MINS, i.order)


def q_transfer_matrix_from_rides(i: Inputs) -> DataFrame:
    return create_transfer_df(i.rides_enriched, TRANSFER_MINS, i.order, rides=True)


def q_transfer_flags(i: Inputs) -> DataFrame:
    return identify_transfer_for_time(i.enriched, TRANSFER_MINS, i.order).select(
        *KEY, "participantname", "participantname_transfer", "tagon_time",
        "time_from_prev_tagon", "time_from_prev", "is_transfer")


def q_rides(i: Inputs) -> DataFrame:
    return as_rides(i.taps, i.order).select(
        *KEY, "operatorid", "subtype", "purseamount", "tagging_off", "tagon_time", "trip_duration",
        "previous_purseamount", "trip_cost")


def q_transfer_time(i: Inputs) -> DataFrame:
    return add_transfer_time(i.enriched, i.order).select(
        *KEY, "participantname", "previous_time", "transfer_time", "previous_participant")


def q_journeys(i: Inputs) -> DataFrame:
    return add_journey_id(i.enriched, JOURNEY_GAP, i.order, keep=KEY).select(
        *KEY, "transfer_time", "is_transfer", "journey_id", "num_legs")


FLAG_COLS = ["is_focal", "from_focal", "to_focal", "exit_to_not_focal", "entrance_from_not_focal"]


def q_focal_flags(i: Inputs) -> DataFrame:
    return focal_identify(i.taps, order=i.order).select(*KEY, "operatorid", *FLAG_COLS)


META_COLS = [
    "timediff", "time_of_previous", "transfer_from_time", "transfer_to_operator_time",
    "transfer_to_not_focal", "transfer_from_not_focal", "transfer_to_operator", "transfer_to_route",
    "transfer_from_operator", "transfer_from_route", "transfer_from_operator_time",
]


def q_focal_metadata(i: Inputs) -> DataFrame:
    marked = focal_identify(i.enriched, order=i.order)
    return focal_lag_and_lead_metadata(marked, order=i.order).select(*KEY, *FLAG_COLS, *META_COLS)


def q_focal_journeys(i: Inputs) -> DataFrame:
    # tripsequencenumber is a pass-through column that the fixture leaves null.
    return i.focal_journeys.drop("tripsequencenumber")


def q_focal_riders(i: Inputs) -> DataFrame:
    return cards_using_operator(i.taps, order=i.order).select(*KEY, "operatorid")


def q_focal_trip_times(i: Inputs) -> DataFrame:
    parts = [f"{p}_{x}" for p in ("tag_on", "tag_out") for x in ("hour", "minute", "yday", "wday", "month")]
    return nicetime(i.focal_journeys).select(*KEY, *parts)


F2F_COLS = ["first_trip", "second_trip", "timediff", "time_of_previous", "locationname_origin",
            "locationname_destination"]


def q_focal_to_focal(i: Inputs) -> DataFrame:
    return focal_to_focal(i.enriched, order=i.order).select(*KEY, *F2F_COLS)


PAIR_COLS = ["originlocation", "destinationlocation", "second_originlocation", "second_destinationlocation",
             "second_locationname_origin", "second_locationname_destination", "second_timediff",
             "second_time_of_previous"]


def q_focal_pairs(i: Inputs) -> DataFrame:
    return combined_focal_transactions(focal_to_focal(i.enriched, order=i.order), i.order).select(*KEY, *PAIR_COLS)


def q_tap_counts(i: Inputs) -> DataFrame:
    marked = spread_time_column(focal_identify(i.taps, order=i.order), prefix="")
    return tap_counts(marked, i.order).select("cardid_anony", "sequencenumber", "yday", "is_focal",
                                     "transaction_count", "focal_tr_count", "tr_count_diff")


ENRICHED_COLS = [
    "transaction_time", "generationtime", "cardid_anony", "operatorid", "routeid", "subtype",
    "contractid", "productcategory", "transferoperator", "transferdiscountflag", "originlocation",
    "sequencenumber", "destinationlocation", "purseamount", "participantname",
    "participantname_transfer", "routename", "locationname_origin", "locationname_destination",
]


def q_enriched(i: Inputs) -> DataFrame:
    return i.enriched.select(*ENRICHED_COLS)


def q_product_description(i: Inputs) -> DataFrame:
    return get_product_description(i.taps, *i.products()).select(
        *KEY, "operatorid", "contractid", "product_description")


def q_product_usage(i: Inputs) -> DataFrame:
    rides = get_product_description(as_rides(i.taps, i.order), *i.products())
    return reports.product_usage(rides, PRODUCT_TOP)


DAY_COLS = ["transaction_time", "generationtime", "cardid_anony", "operatorid", "routeid", "subtype",
            "contractid", "productcategory", "transferoperator", "transferdiscountflag", "originlocation",
            "sequencenumber", "destinationlocation", "purseamount"]


def q_service_day(i: Inputs) -> DataFrame:
    return fares_for_day(i.raw, SERVICE_DATE).select(*DAY_COLS)


def q_day_table(i: Inputs) -> DataFrame:
    """The service day written as a day table in the shared folder and read back."""
    path = scratch(i, "day")
    write_day_table(fares_for_day(i.raw, SERVICE_DATE), path, SERVICE_DATE)
    return i.spark.read.parquet(path).select(*DAY_COLS, "service_date")


def scratch(i: Inputs, stem: str) -> str:
    """A path not yet used in the shared folder."""
    return f"{checkpoint_dir(i.spark).rstrip('/')}/faretrail-{stem}-{uuid.uuid4().hex}"


def q_lookups(i: Inputs) -> DataFrame:
    """Keys and names of the lookup tables, written to the shared folder and opened by name."""
    folder = scratch(i, "lookups")
    for name, df in zip(src.LOOKUPS, i.dims):
        df.write.parquet(f"{folder}/{name}")
    keys = {"operators": ("participantid", None, "participantname"), "routes": ("participantid", "routeid", "routename"),
            "locations": ("participantid", "locationcode", "locationname")}
    parts = []
    for name, df in descriptive_tables(i.spark, folder).items():
        operator, key, label = keys[name]
        parts.append(df.select(F.lit(name).alias("lookup"), F.col(operator).alias("operator"),
                               (F.col(key) if key else F.lit(None)).cast("int").alias("key"), F.col(label).alias("label")))
    return reduce(DataFrame.unionByName, parts)


def q_file_manifest(i: Inputs) -> DataFrame:
    """The taps and their transfers of each month written as files of that name, and the manifest of the folder's listing."""
    folder = scratch(i, "months")
    month = F.date_format("generationtime", "yyyy - MM")
    kinds = F.explode(F.array(*[F.lit(kind) for kind, _ in src.MANIFEST_TYPES]))
    rows = i.raw.select("sequencenumber", "transferdiscountflag", month.alias("month"), kinds.alias("kind")).where(
        "kind = 'Transaction' OR transferdiscountflag = 1")
    named = rows.select("sequencenumber", F.concat("month", F.lit(" "), "kind", F.lit(".csv")).alias("file"))
    named.repartition("file").write.partitionBy("file").csv(folder)
    return src.file_manifest(src.list_files(i.spark, folder))


def q_transfer_rules_csv(i: Inputs) -> DataFrame:
    """The agency rules written as CSV to the shared folder and read back."""
    path = scratch(i, "rules")
    src.transfer_rules_from(i.nation).write.option("header", True).option("quote", "'").csv(path)
    return src.read_transfer_rules(i.spark, path)


def q_day_of_rides(i: Inputs) -> DataFrame:
    day = fares_for_day(i.raw, SERVICE_DATE)
    return as_rides(day, i.base.order_of(day)).select(*KEY, "subtype", "tagon_time", "trip_duration", "trip_cost")


def q_day_transactions(i: Inputs) -> DataFrame:
    return day_of_transactions(i.raw, SERVICE_DATE, *i.dims).select(*ENRICHED_COLS)


def q_sample_day(i: Inputs) -> DataFrame:
    return sample_day_of_transactions(i.raw, SERVICE_DATE, SAMPLE_CARDS, *i.dims, seed=SAMPLE_SEED, check=False).select(
        *ENRICHED_COLS)


def q_card_sample(i: Inputs) -> DataFrame:
    return sample_user_transactions(i.taps, SAMPLE_CARDS, SAMPLE_SEED, check=False).select(*KEY, "operatorid")


def q_card_sample_of_days(i: Inputs) -> DataFrame:
    """Taps of cards sampled from the states of all days, which are written a day apart and merged."""
    path = scratch(i, "sample")
    write_sample_state(i.taps.withColumn("service_date", F.to_date("transaction_time")), path, SAMPLE_CARDS, SAMPLE_SEED)
    ids = merge_samples(i.spark.read.parquet(path), SAMPLE_CARDS, check=False)
    return i.taps.join(ids, "cardid_anony", "left_semi").select(*KEY, "operatorid")


def q_time_columns(i: Inputs) -> DataFrame:
    return spread_time_column(i.taps).select(*KEY, "t_hour", "t_minute", "t_yday", "t_wday", "t_month")


def q_od_matrix(i: Inputs) -> DataFrame:
    return reports.od_matrix(i.focal_journeys)


def q_top_movements(i: Inputs) -> DataFrame:
    return reports.top_movements(i.focal_journeys, TOP_K)


def q_hour_histogram(i: Inputs) -> DataFrame:
    return reports.hour_histogram(i.focal_journeys, "time_of_previous", "focal_tag_on").unionByName(
        reports.hour_histogram(i.taps, "transaction_time", "all_taps"))


def q_rule_transfers(i: Inputs) -> DataFrame:
    return i.rule_classified.select(*KEY, "previous_participant", "participantname", "transfer_time",
                                    "max_time", "is_rule_transfer")


def q_transfer_database(i: Inputs) -> DataFrame:
    return i.transfer_db


def q_shares(i: Inputs) -> DataFrame:
    return i.shares


def q_pair_day_csv(i: Inputs) -> DataFrame:
    """The transfer database written as the pair-day CSV, read back, and its shares."""
    path = scratch(i, "pairs")
    src.write_pair_day(i.transfer_db, path)
    return reports.transfer_shares(src.read_pair_day(i.spark, path))


def q_transfer_database_upkeep(i: Inputs) -> DataFrame:
    """The transfer database kept from a table of service days: odd days first, then all of them, the odd ones again."""
    from faretrail.streaming.transfer_db import read_transfer_database, refresh_transfer_database

    table, sink = scratch(i, "days"), scratch(i, "database")
    days = i.taps.withColumn("service_date", F.to_date(F.expr("transaction_time - INTERVAL 3 HOURS")))
    days.repartition("service_date").write.partitionBy("service_date").parquet(table)
    touched = i.spark.read.parquet(table).select("service_date").distinct()
    rules = src.transfer_rules_from(i.nation)
    for part in (touched.where("day(service_date) % 2 = 1"), touched):
        refresh_transfer_database(i.spark, table, sink, part, i.dims, rules, SAMPLING_RATE, i.segment_rows)
    return read_transfer_database(i.spark, sink)


def q_median_gaps(i: Inputs) -> DataFrame:
    """Median minutes between rides of a card, by the two operators."""
    gaps = add_transfer_time(i.enriched, i.order)
    return exact_medians(gaps, ["previous_participant", "participantname"], "transfer_time", "median_minutes")


def q_median_share_chart(i: Inputs) -> DataFrame:
    return reports.median_from_share(i.shares, CHART_AGENCY)


def q_share_by_from(i: Inputs) -> DataFrame:
    return reports.share_by_from(i.shares)


def q_share_by_to(i: Inputs) -> DataFrame:
    return reports.share_by_to(i.shares)


def q_agency_transactions(i: Inputs) -> DataFrame:
    return reports.agency_transactions(i.transfer_db)


def q_observed_days(i: Inputs) -> DataFrame:
    return reports.observed_days(i.transfer_db)


def q_share_by_from_years(i: Inputs) -> DataFrame:
    return reports.pivoted(reports.share_by_from(i.shares), "Year", ["median_transfers", "median_from_transactions", "median_from_share"], REPORT_YEARS)


def q_share_by_to_years(i: Inputs) -> DataFrame:
    return reports.pivoted(reports.share_by_to(i.shares), "Year", ["median_transfers", "median_to_transactions", "median_to_share"], REPORT_YEARS)


def q_agency_transactions_weekdays(i: Inputs) -> DataFrame:
    return reports.pivoted(reports.agency_transactions(i.transfer_db), "CircadianDayOfWeek", ["median_from_transactions"], list(range(1, 8)))


def q_observed_days_years(i: Inputs) -> DataFrame:
    return reports.pivoted(reports.observed_days(i.transfer_db), "Year", ["observed_weeks"], REPORT_YEARS)


def q_transfers_with_totals(i: Inputs) -> DataFrame:
    return reports.transfers_with_totals(i.transfer_db)


def q_sequences_by_date(i: Inputs) -> DataFrame:
    return extract_sequence_by_date(i.rides_enriched, i.order)


def q_sequences_by_day_id(i: Inputs) -> DataFrame:
    return extract_sequence_for_random_week(i.rides_enriched, i.order)


def q_sequences_sampled_trips(i: Inputs) -> DataFrame:
    trips = src.sampled_trips_from(i.rides_enriched)
    return sequences_of_sampled_trips(trips, i.order.renamed({"cardid_anony": "ClipperCardID"}))


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "transfer_matrix": q_transfer_matrix,
    "transfer_matrix_from_rides": q_transfer_matrix_from_rides,
    "day_table": q_day_table,
    "lookups": q_lookups,
    "file_manifest": q_file_manifest,
    "transfer_rules_csv": q_transfer_rules_csv,
    "transfer_flags": q_transfer_flags,
    "rides": q_rides,
    "transfer_time": q_transfer_time,
    "journeys": q_journeys,
    "focal_flags": q_focal_flags,
    "focal_metadata": q_focal_metadata,
    "focal_journeys": q_focal_journeys,
    "focal_riders": q_focal_riders,
    "focal_trip_times": q_focal_trip_times,
    "focal_to_focal": q_focal_to_focal,
    "focal_pairs": q_focal_pairs,
    "tap_counts": q_tap_counts,
    "enriched": q_enriched,
    "product_description": q_product_description,
    "product_usage": q_product_usage,
    "service_day": q_service_day,
    "day_of_rides": q_day_of_rides,
    "day_transactions": q_day_transactions,
    "sample_day": q_sample_day,
    "card_sample": q_card_sample,
    "time_columns": q_time_columns,
    "od_matrix": q_od_matrix,
    "top_movements": q_top_movements,
    "hour_histogram": q_hour_histogram,
    "rule_transfers": q_rule_transfers,
    "transfer_database": q_transfer_database,
    "shares": q_shares,
    "median_share_chart": q_median_share_chart,
    "share_by_from": q_share_by_from,
    "share_by_to": q_share_by_to,
    "agency_transactions": q_agency_transactions,
    "observed_days": q_observed_days,
    "transfers_with_totals": q_transfers_with_totals,
    "share_by_from_years": q_share_by_from_years,
    "share_by_to_years": q_share_by_to_years,
    "agency_transactions_weekdays": q_agency_transactions_weekdays,
    "observed_days_years": q_observed_days_years,
    "sequences_by_date": q_sequences_by_date,
    "sequences_by_day_id": q_sequences_by_day_id,
    "sequences_sampled_trips": q_sequences_sampled_trips,
    "pair_day_csv": q_pair_day_csv,
    "transfer_database_upkeep": q_transfer_database_upkeep,
    "median_gaps": q_median_gaps,
    "card_sample_of_days": q_card_sample_of_days,
}


def run(name: str, spark: SparkSession, sf_dir: str, segment_rows: int | None = SEGMENT_ROWS) -> DataFrame:
    return QUERIES[name](Inputs(spark, sf_dir, segment_rows))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``name -> (spark, sf_dir) -> DataFrame`` for the driver contract."""
    def bind(name):
        return lambda spark, sf_dir: run(name, spark, sf_dir)
    return {name: bind(name) for name in QUERIES}
