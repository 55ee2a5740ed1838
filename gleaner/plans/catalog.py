"""All queries over the given tables."""

from gleaner.plans import ordered_queries, pair_queries, review_queries, rule_queries, table_queries  # noqa: F401  they register themselves
from gleaner.plans.registry import ORACLES, QUERIES  # noqa: F401
