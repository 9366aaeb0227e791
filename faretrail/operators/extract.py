"""Service-day extraction, card anonymisation, card sampling and the day-table sink.

A *service day* starts at a fixed UTC instant (10:00 UTC by default, 3 am
Pacific in winter) and lasts 24 hours. Predicates are written on the raw
``generationtime`` column so they reach the Parquet scan (and the
``service_date`` partition column when the source is partitioned).
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretrail.operators.enrich import make_human_readable
from faretrail.operators.ordering import SEGMENT, CardOrder
from faretrail.schema import CARD, DAY_BOUNDARY_UTC, DAY_COLUMNS, MAX_SERIAL, SEQ, TIME
from faretrail.sources.lookups import open_tables

LOCAL_ZONE = "America/Los_Angeles"


def day_bounds(start_date: str, partition_time: str = DAY_BOUNDARY_UTC, boundary: str = "utc",
               zone: str = "America/Los_Angeles") -> tuple[str, str]:
    """UTC bounds of a service day as literals (so they push down to the scan).

    ``boundary='utc'``: ``partition_time`` is a UTC clock time (fixed instant
    every day). ``boundary='local'``: it is a local clock time in ``zone``, so
    the UTC instant follows daylight-saving time (a 23- or 25-hour day on the
    switch days).
    """
    start = dt.date.fromisoformat(str(start_date))
    end = start + dt.timedelta(days=1)
    if boundary == "utc":
        return f"{start.isoformat()} {partition_time}", f"{end.isoformat()} {partition_time}"
    if boundary != "local":
        raise ValueError("boundary must be 'utc' or 'local'")
    from zoneinfo import ZoneInfo
    clock = dt.time.fromisoformat(partition_time)
    tz, utc = ZoneInfo(zone), dt.timezone.utc

    def to_utc(day: dt.date) -> str:
        local = dt.datetime.combine(day, clock, tzinfo=tz)
        return local.astimezone(utc).replace(tzinfo=None).isoformat(sep=" ")

    return to_utc(start), to_utc(end)


def card_hash(serial) -> F.Column:
    """Anonymised card id: SHA-1 (hex) of the serial number as text."""
    c = F.col(serial) if isinstance(serial, str) else serial
    return F.sha1(c.cast("string"))


def to_local_time(utc_col, zone: str = LOCAL_ZONE) -> F.Column:
    """UTC wall clock to local wall clock (DST-aware, stays timestamp_ntz)."""
    c = F.col(utc_col) if isinstance(utc_col, str) else utc_col
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)


def fares_for_day(raw: DataFrame, start_date: str, partition_time: str = DAY_BOUNDARY_UTC,
                  max_serial: int = MAX_SERIAL, strict: bool = False, keep_serial: bool = False,
                  zone: str = LOCAL_ZONE, boundary: str = "utc") -> DataFrame:
    """One service day of raw transactions in day-table shape.

    The day is ``[start, next start)`` with the start at ``partition_time``
    (UTC clock by default, local clock with ``boundary='local'``);
    ``strict=True`` excludes the start instant too (both bounds open). The
    card serial is replaced by its hash unless ``keep_serial``.

    A ``service_date`` column (the partition column of stored taps: the UTC or
    local date, or the service day, of ``generationtime``) is filtered too, so
    that only the partitions around the day are read; rows without it stay.
    """
    lo, hi = day_bounds(start_date, partition_time, boundary, zone)
    g = F.col("generationtime")
    lower = g > F.lit(lo).cast("timestamp_ntz") if strict else g >= F.lit(lo).cast("timestamp_ntz")
    day = raw.where(lower & (g < F.lit(hi).cast("timestamp_ntz")) &
                    (F.col("applicationserialnumber") < max_serial))
    if "service_date" in raw.columns:
        first, last = (F.to_date(F.lit(x).cast("timestamp_ntz")) for x in (lo, hi))
        day = day.where(F.col("service_date").isNull() | F.col("service_date").between(F.date_sub(first, 1), last))
    cols = []
    for name in DAY_COLUMNS:
        if name == TIME:
            cols.append(to_local_time("generationtime", zone).alias(TIME))
        elif name == CARD:
            cols.append(card_hash("applicationserialnumber").alias(CARD))
        elif name == "applicationserialnumber" and not keep_serial:
            continue
        else:
            cols.append(F.col(name))
    return day.select(*cols)


def _draw(card, seed: int) -> F.Column:
    """A card's place in the seeded hash order."""
    return F.sha1(F.concat(card, F.lit(f"#{seed}")))


def _exactly(picked: DataFrame, n_users: int) -> DataFrame:
    """``picked`` (at most ``n_users`` cards), or an error from the running plan when there are fewer.

    The sample becomes one row with all its cards, a row that is there for an
    empty population too.
    """
    return _one_row(picked, n_users).select(F.explode("cards").alias(CARD))


def _one_row(picked: DataFrame, n_users: int) -> DataFrame:
    one = picked.agg(F.collect_list(CARD).alias("cards"))
    found = F.size("cards")
    message = F.concat(F.lit(f"cannot sample {n_users} cards from "), found.cast("string"))
    return one.select(F.when(found < n_users, F.raise_error(message)).otherwise(F.col("cards")).alias("cards"))


def sample_card_ids(tr: DataFrame, n_users: int, seed: int = 0, check: bool = False) -> DataFrame:
    """``n_users`` distinct cards, chosen by a seeded hash order.

    Deterministic and uniform over cards (the hash is independent of the
    id's order). A per-partition top-n then a merge: only ``n_users`` rows
    per partition reach the final step. With ``check`` the plan itself raises
    when there are fewer cards, or none; without it all of them are returned.
    """
    ids = tr.select(CARD).where(F.col(CARD).isNotNull()).distinct()
    picked = ids.orderBy(_draw(F.col(CARD), seed), F.col(CARD)).limit(n_users)
    return _exactly(picked, n_users) if check else picked


def sample_state(tr: DataFrame, n_users: int, seed: int = 0, by: str = "service_date") -> DataFrame:
    """The mergeable state of a sample: of each ``by`` its ``n_users`` first cards in the hash order.

    ``(by, draw, card)``, at most ``n_users`` rows a day. A card that is among
    the first of all days is among the first of each day it was used on, so
    :func:`merge_samples` of any days' states gives the sample of these days
    without their taps. Only a map task's first cards of a day are shuffled
    (Spark limits the window before its exchange). Null cards are left out.
    """
    ids = tr.select(by, CARD).where(F.col(CARD).isNotNull()).distinct().withColumn("draw", _draw(F.col(CARD), seed))
    place = F.row_number().over(Window.partitionBy(by).orderBy("draw", CARD))
    return ids.withColumn("_place", place).where(F.col("_place") <= n_users).select(by, "draw", CARD)


def write_sample_state(tr: DataFrame, path: str, n_users: int, seed: int = 0, by: str = "service_date") -> None:
    """Persist the states of the days in ``tr``, one partition a day; days written before are replaced, others stay."""
    (sample_state(tr, n_users, seed, by).repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(path))


def merge_samples(states: DataFrame, n_users: int, check: bool = True) -> DataFrame:
    """The sample of ``n_users`` cards over all days of ``states``: what :func:`sample_card_ids` draws from their taps.

    ``states`` must hold at least ``n_users`` cards a day (or all of a day's
    cards). ``check``: running the plan fails when there are fewer, or none.
    """
    picked = states.select("draw", CARD).distinct().orderBy("draw", CARD).limit(n_users).select(CARD)
    return _exactly(picked, n_users) if check else picked


def sample_user_transactions(tr: DataFrame, n_users: int, seed: int = 0, check: bool = True) -> DataFrame:
    """All taps of ``n_users`` sampled cards (semi-join on the sampled ids).

    ``check``: running the plan fails when there are fewer cards, or none.
    """
    ids = sample_card_ids(tr, n_users, seed, check)
    taps = tr.join(ids, CARD, "left_semi")
    if not check:
        return taps
    # Spark skips a semi-join of no taps, so the size is also looked at in a branch that adds no rows
    guard = _one_row(sample_card_ids(tr, n_users, seed), n_users).where(F.size("cards") < n_users)
    return taps.union(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in taps.schema.fields]))


def day_of_transactions(raw: DataFrame, start_date: str, participants: DataFrame, routes: DataFrame,
                        locations: DataFrame, **kw) -> DataFrame:
    """All taps of one service day with operator, route and location names."""
    return make_human_readable(fares_for_day(raw, start_date, **kw), participants, routes, locations)


def sample_day_of_transactions(raw: DataFrame, start_date: str, n_users: int, participants: DataFrame,
                               routes: DataFrame, locations: DataFrame, seed: int = 0, check: bool = True,
                               **kw) -> DataFrame:
    """Taps of ``n_users`` sampled cards on one service day, made readable.

    ``check=False`` returns all cards when fewer than ``n_users`` exist
    instead of failing.
    """
    day = fares_for_day(raw, start_date, **kw)
    return make_human_readable(sample_user_transactions(day, n_users, seed, check), participants, routes,
                               locations)


#: Bytes of a row group of a day table, the unit that a card lookup reads.
ROW_GROUP_BYTES = 32 << 20


def write_day_table(day: DataFrame, path: str, service_date: str, mode: str = "overwrite",
                    row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Persist a service day clustered for the card windows and for card lookups.

    Rows are dealt by ranges of (card, time, sequence), so a card of very many
    taps spans several files, and sorted so inside each file, under a
    ``service_date=`` partition; with dynamic partition overwrite only that day
    is replaced. Row groups are small, so their least and largest card are a
    zone map, and hold a Bloom filter on the card: ``cardid_anony = ...`` reads
    the row groups of that card alone (see :func:`taps_of_card`).
    """
    out = (
        day.withColumn("service_date", F.lit(service_date).cast("date"))
        .repartitionByRange(CARD, TIME, SEQ)
        .sortWithinPartitions(CARD, TIME, SEQ)
    )
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("parquet.block.size", row_group_bytes)
     .option(f"parquet.bloom.filter.enabled#{CARD}", True).option("parquet.bloom.filter.adaptive.enabled", True)
     .partitionBy("service_date").parquet(path))


def taps_of_card(days: DataFrame, serial: int | None = None, card: str | None = None) -> DataFrame:
    """The stored taps of one card, given by its serial or its hash; the filter is a literal that reaches the row groups."""
    if (serial is None) == (card is None):
        raise ValueError("give the card's serial or its hash")
    if card is None:
        card = hashlib.sha1(str(serial).encode()).hexdigest()
    return days.where(F.col(CARD) == card)


def save_day_table(day: DataFrame, table: str, path: str, service_date: str, buckets: int = 64,
                   segment_rows: int | None = 2_000_000) -> None:
    """Persist a service day into a catalog table bucketed and sorted by card.

    The table is partitioned by ``service_date`` and bucketed on
    ``cardid_anony`` (sorted by card, time, sequence inside each bucket).
    Reading it back, Spark knows every card sits in one bucket, so the card
    windows of all operators run without any exchange. Re-saving a day
    replaces only that day (dynamic partition overwrite). ``buckets`` should
    give bucket files of a few hundred MB per day. A bucket is written by one
    task; cards of more than ``segment_rows`` taps by several, into files of
    their bucket.
    """
    spark = day.sparkSession
    order = CardOrder.settle(day.select(CARD), segment_rows)
    out = day.withColumn("service_date", F.lit(service_date).cast("date"))
    if order.hot is None:
        out = out.repartition(buckets, CARD)
    else:
        columns = out.columns
        out = order.segments(out, order.order).repartition(buckets, F.pmod(F.hash(CARD), F.lit(buckets)), SEGMENT).select(*columns)
    if not spark.catalog.tableExists(table):
        # the table keeps the option, so that saving a day again replaces that day alone
        (out.write.format("parquet").partitionBy("service_date").bucketBy(buckets, CARD)
         .sortBy(CARD, TIME, SEQ).option("path", path).option("partitionOverwriteMode", "dynamic").saveAsTable(table))
    else:
        out.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)


def descriptive_tables(spark: SparkSession, source: str | None = None) -> dict[str, DataFrame]:
    """The lookup tables (operators, routes, locations) opened by name: see :func:`faretrail.sources.open_tables`."""
    return open_tables(spark, source)


def write_transfer_database(db: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the pair-day transfer database partitioned by (Year, Month).

    With ``mode='overwrite'`` only the months present in ``db`` are replaced
    (dynamic partition overwrite), so rebuilding a month is idempotent;
    ``mode='append'`` adds rows.
    """
    (db.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("Year", "Month").parquet(path))
