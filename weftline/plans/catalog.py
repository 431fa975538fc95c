"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from weftline.plans import data_queries, network_oracles, network_queries, record_queries, source_queries

QUERIES = {**data_queries.QUERIES, **network_queries.QUERIES, **record_queries.QUERIES, **source_queries.QUERIES}
ORACLES = {**data_queries.ORACLES, **network_oracles.ORACLES, **record_queries.ORACLES, **source_queries.ORACLES}
FLAGSHIP = network_queries.QUERIES["edg3_edges_year"]
