"""Plans, and the queries that hold them against SQL."""

from . import change_queries, queries, scan_queries, sink_queries, source_queries  # noqa: F401  (all fill the list of queries)
