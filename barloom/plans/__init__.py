"""Registered queries and their reference SQL."""

from . import data_queries, feature_queries, market_queries, metric_queries, portfolio_queries, table_queries

_PARTS = (data_queries, feature_queries, market_queries, metric_queries, portfolio_queries, table_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
