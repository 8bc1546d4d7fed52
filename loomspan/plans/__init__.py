"""Queries over the test tables, each with equivalent SQL where SQL can express it."""

from loomspan.plans import composite_plans, dealt, matching_plans, signal_plans, source_plans, stats_plans

MODULES = [dealt, signal_plans, matching_plans, stats_plans, composite_plans, source_plans]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark, d):
    return signal_plans.primary_domain(spark, d)
