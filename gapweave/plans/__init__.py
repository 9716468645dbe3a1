"""Registered queries."""


def load_all():
    """Import the query modules and return (queries, check SQL)."""
    from gapweave.plans import q_core, q_metrics, q_models, q_specs, q_tables  # noqa: F401
    from gapweave.plans.registry import QUERIES, SQL

    return QUERIES, SQL
