"""Streaming: incremental per-service-day results over a growing day table."""

from faretrail.streaming.daily import day_matrix, read_daily_matrix, start_daily_transfer_matrix

__all__ = ["day_matrix", "read_daily_matrix", "start_daily_transfer_matrix"]
