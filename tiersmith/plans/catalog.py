"""Imports every query module, which fills the registry."""

from tiersmith.plans import (queries_features, queries_fits, queries_relational, queries_rows, queries_runs, queries_sampling, queries_sources,  # noqa: F401
                             queries_stats)  # noqa: F401
from tiersmith.plans.registry import QUERIES, SQL  # noqa: F401
