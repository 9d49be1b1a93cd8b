"""Session-activity analytics on Spark.

Events of many editor sessions live in one table keyed by ``(session_id, seq)``;
every operator is a DataFrame -> DataFrame function built from Spark windows,
aggregations and joins.  See README.md for the operator map.
"""

from sessionlog.config import AggregationConfig, ExecConfig, FilterConfig

__all__ = ["AggregationConfig", "ExecConfig", "FilterConfig"]
