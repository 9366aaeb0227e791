"""faretrail — transit smart-card analytics on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, card-partitioned windows, joins and aggregates, so a chain of
operators is one lazy plan that Catalyst optimises and the cluster executes.
"""

from faretrail.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
