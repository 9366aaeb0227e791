"""Column-expression helpers shared by the operators (all JVM-side)."""

from faretrail.functions.scalars import (
    exact_sum,
    minutes_between,
    round2,
    paste,
    month_label,
    weekday_name,
)
from faretrail.functions.timecols import spread_time_column, nicetime

__all__ = [
    "exact_sum", "minutes_between", "round2", "paste", "month_label", "weekday_name",
    "spread_time_column", "nicetime",
]
