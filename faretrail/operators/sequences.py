"""Travel-sequence frequencies: how many cards made the same sequence of rides
on a day.

A ride's record is ``"<tag-on hour> <origin name> <destination name>"`` (a
missing name is written ``NA``). A card's records on one circadian day are
joined in ride order into one string; cards are then counted per (day,
string). Records are joined with a sorted ``collect_list`` per (card, day).
The records of hot cards (see ``CardOrder``) are first cut into runs of
``PIECE`` ranks in their order and joined per (card, day, run), so no task
gathers more than a run's records however they are spread over the day; the
runs' texts, which together are the result's own value, are then joined in
their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.functions.scalars import month_label, paste, weekday_name
from faretrail.operators.ordering import SEGMENT, CardOrder
from faretrail.schema import CARD, SEQ, SERVICE_DAY_START_HOUR, TIME

#: Records of a hot card that are joined at a time.
PIECE = 100_000


def tag_on_instant() -> F.Column:
    """Tag-on time of a ride (its own time for single-tap rides)."""
    return F.coalesce(F.col("tagon_time"), F.col(TIME))


def circadian_date(ts) -> F.Column:
    """Service date: the day starts at 3 am local time."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c - F.expr(f"INTERVAL {SERVICE_DAY_START_HOUR} HOURS"))


def sequence_records(rides: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """One record per ride with its circadian date, ordering keys and segment."""
    on = tag_on_instant()
    recs = rides.select(
        CARD,
        circadian_date(on).alias("CircadianDate"),
        on.alias("_on"),
        F.col(SEQ).alias("_seq"),
        paste(F.hour(on), "locationname_origin", "locationname_destination").alias("_record"),
    )
    return _in_pieces(recs, order, ("_on", "_seq")).withColumnRenamed(CARD, "CardID")


def _in_pieces(recs: DataFrame, order: CardOrder | None, by: tuple[str, ...]) -> DataFrame:
    """Mark the runs of hot cards' records; without hot cards the records are as they were."""
    if order is None or order.hot is None:
        return recs
    return order.segments(recs, by, min(PIECE, order.segment_rows))


def _joined(recs: DataFrame, group_cols: list[str], by: tuple[str, ...] = ("_on", "_seq")) -> DataFrame:
    """RunSequence per group: records joined in the order of ``by``, piece by piece where there are pieces."""
    def join_sorted(col):
        return F.array_join(F.transform(F.array_sort(F.collect_list(col)), lambda x: x["_record"]), " ")

    if SEGMENT not in recs.columns:
        return recs.groupBy(*group_cols).agg(join_sorted(F.struct(*by, "_record")).alias("RunSequence"))
    parts = recs.groupBy(*group_cols, SEGMENT).agg(join_sorted(F.struct(*by, "_record")).alias("_record"))
    return parts.groupBy(*group_cols).agg(join_sorted(F.struct(SEGMENT, "_record")).alias("RunSequence"))


def extract_sequence_by_date(rides: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """Cards per (circadian date, ride sequence), with the weekday name."""
    per_card = _joined(sequence_records(rides, order), ["CardID", "CircadianDate"])
    return per_card.groupBy("CircadianDate", "RunSequence").agg(F.count(F.lit(1)).alias("n")).select(
        "CircadianDate",
        weekday_name(F.dayofweek("CircadianDate")).alias("CircadianDayOfWeek"),
        "RunSequence", "n",
    )


def day_id_columns(date_col) -> list:
    """Year, Month, weekday (1 = Sunday), week of month and the packed DayID."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    year, month, dow = F.year(d), F.month(d), F.dayofweek(d)
    week = F.ceil(F.dayofmonth(d) / F.lit(7)).cast("int")
    day_id = (F.lit(1000000) * year.cast("long") + F.lit(10000) * month + F.lit(100) * dow + week)
    return [year.alias("Year"), month.alias("Month"), dow.alias("CircadianDayOfWeek"),
            week.alias("RandomWeekID"), day_id.cast("long").alias("DayID")]


def extract_sequence_for_random_week(rides: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """Cards per (sampled day, ride sequence); the day is packed as
    ``DayID = 1e6*Year + 1e4*Month + 100*weekday + week`` and decoded back
    to year, month name, weekday name and week for the result."""
    recs = sequence_records(rides, order)
    recs = recs.select("*", *day_id_columns("CircadianDate")).drop("CircadianDate")
    return _counted_days(_joined(recs, ["CardID", "DayID"]))


def _counted_days(per_card: DataFrame) -> DataFrame:
    """Cards per (DayID, sequence), with the day's parts decoded from its id (null for a null id)."""
    counts = per_card.groupBy("DayID", "RunSequence").agg(F.count(F.lit(1)).alias("n"))
    month = F.when(F.col("DayID").isNotNull(), month_label(F.expr("(DayID div 10000) % 100").cast("int")))
    return counts.select(
        "DayID",
        F.expr("DayID div 1000000").cast("int").alias("Year"),
        month.alias("Month"),
        weekday_name(F.expr("(DayID div 100) % 100").cast("int")).alias("CircadianDayOfWeek"),
        (F.col("DayID") % 100).cast("int").alias("RandomWeekID"),
        "RunSequence", "n",
    )


#: Columns of a table of trips on sampled days, as it is given.
TRIP_COLUMNS = ("ClipperCardID", "Year", "Month", "CircadianDayOfWeek", "RandomWeekID", "TripSequenceID",
                "TagOnTime_Time", "TagOnLocationName", "TagOffLocationName")


def sequences_of_sampled_trips(trips: DataFrame, order: CardOrder | None = None) -> DataFrame:
    """Cards per (sampled day, trip sequence) of a given table of trips.

    The day is given by its parts (``Year``, ``Month``, weekday 1 = Sunday,
    ``RandomWeekID``) and packed as in :func:`extract_sequence_for_random_week`;
    a missing part makes the day null, and such trips a day of their own. A
    trip's record is the hour in the first two characters of
    ``TagOnTime_Time``, the tag-on and the tag-off location (``NA`` where
    missing). A card's records of a day are joined in the order of
    ``TripSequenceID``, whatever the times say; equal or missing ids are ordered
    by time and record. ``order``: the split of hot cards, keyed by
    ``ClipperCardID`` (see :meth:`CardOrder.settle`).
    """
    missing = [c for c in TRIP_COLUMNS if c.lower() not in {x.lower() for x in trips.columns}]
    if missing:
        raise ValueError(f"trips lack {', '.join(missing)}")
    hour = F.expr("try_cast(substring(cast(TagOnTime_Time AS string), 1, 2) AS int)")
    day = (F.lit(1000000) * F.col("Year").cast("long") + F.lit(10000) * F.col("Month") + F.lit(100) * F.col("CircadianDayOfWeek")
           + F.col("RandomWeekID")).cast("long")
    recs = trips.select(
        "ClipperCardID", day.alias("DayID"),
        # missing ids come last, as they do when pieces are cut
        F.col("TripSequenceID").isNull().alias("_none"), F.col("TripSequenceID").cast("long").alias("_trip"),
        F.col("TagOnTime_Time").cast("string").alias("_time"),
        paste(hour, "TagOnLocationName", "TagOffLocationName").alias("_record"),
    )
    by = ("_none", "_trip", "_time")
    return _counted_days(_joined(_in_pieces(recs, order, ("DayID", *by, "_record")), ["ClipperCardID", "DayID"], by))
