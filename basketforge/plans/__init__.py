"""The registered retail queries."""

from basketforge.plans import customer_queries, evaluation_queries, feature_queries, graph_queries, pricing_queries, report_queries, sample_queries, temporal_queries
from basketforge.plans.registry import QUERIES, SQL


def all_queries() -> dict:
    return QUERIES


def all_sql() -> dict[str, str]:
    return SQL
