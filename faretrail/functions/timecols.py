"""Calendar columns from a timestamp (hour, minute, day of year, weekday, month)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_parts(ts, prefix: str = "t_") -> list:
    """Five columns ``<prefix>{hour,minute,yday,wday,month}``; ``wday`` 1 = Sunday."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return [
        F.hour(c).alias(f"{prefix}hour"),
        F.minute(c).alias(f"{prefix}minute"),
        F.dayofyear(c).alias(f"{prefix}yday"),
        F.dayofweek(c).alias(f"{prefix}wday"),
        F.month(c).alias(f"{prefix}month"),
    ]


def spread_time_column(df: DataFrame, ts: str = "transaction_time", prefix: str = "t_") -> DataFrame:
    """Append the five calendar columns of ``ts`` to every row."""
    return df.select("*", *time_parts(ts, prefix))


def nicetime(df: DataFrame) -> DataFrame:
    """Calendar columns of the trip's two times.

    ``time_of_previous`` (the tap before the focal trip) becomes ``tag_on_*``
    and ``transaction_time`` becomes ``tag_out_*``, as in the tutorial usage.
    """
    return df.select(
        "*",
        *time_parts("time_of_previous", "tag_on_"),
        *time_parts("transaction_time", "tag_out_"),
    )
