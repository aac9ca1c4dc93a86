"""All queries of the core, by name."""

from lodegraph.plans import dealt, graph_queries, report_queries, table_queries

QUERIES = {**dealt.QUERIES, **graph_queries.QUERIES, **table_queries.QUERIES, **report_queries.QUERIES}
ORACLES = {**dealt.ORACLES, **graph_queries.ORACLES, **table_queries.ORACLES, **report_queries.ORACLES}
FLAGSHIP = graph_queries.impact_affected
