"""Queries of the library: name to (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

import waypath.plans.contracts  # noqa: F401 registers its queries
import waypath.plans.flows  # noqa: F401 registers its queries
import waypath.plans.reviews  # noqa: F401 registers its queries
import waypath.plans.traces  # noqa: F401 registers its queries
from waypath.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "variant_reduction"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
