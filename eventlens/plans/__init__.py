"""Query registry. Importing this package registers every plan module."""
from eventlens.plans.base import REGISTRY, Plan, tables  # noqa: F401
from eventlens.plans import (aggregate_plans, event_plans, feature_plans, mapping_plans, market_plans,  # noqa: F401
                             model_plans, serving_plans, signal_plans, source_plans, streaming_plans,
                             text_plans)


def queries():
    return {name: p.fn for name, p in REGISTRY.items()}


def oracle_sql():
    return {name: p.oracle for name, p in REGISTRY.items() if p.oracle}
