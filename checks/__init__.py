"""Registered queries over the given tables and the SQL that checks them."""

import sys

from pyspark import cloudpickle

# the extractors among the checks run on executors, which need no copy of this folder
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from checks.registry import QUERIES, SQL  # noqa: E402
from checks import config_checks, page_checks, site_checks, table_checks  # noqa: F401,E402

__all__ = ["QUERIES", "SQL"]
