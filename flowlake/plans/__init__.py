"""Named plans over the driver tables, each with an optional DuckDB twin."""

from flowlake.plans.registry import PLANS, SQL


def load_all() -> None:
    """Import every plan module so that its plans register."""
    from flowlake.plans import analytics, details, endtoend, models, profile, security, streams, traffic  # noqa: F401


__all__ = ["PLANS", "SQL", "load_all"]
