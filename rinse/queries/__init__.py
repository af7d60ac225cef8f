from rinse.queries import files, profiles, results, specs, transforms  # noqa: F401
from rinse.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
