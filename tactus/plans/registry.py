"""All registered queries of the engine and their SQL."""

from tactus.plans import check_queries, frame_queries, text_queries

QUERIES: dict = text_queries.QUERIES | frame_queries.QUERIES | check_queries.QUERIES
ORACLES: dict[str, str] = text_queries.ORACLES | frame_queries.ORACLES | check_queries.ORACLES
