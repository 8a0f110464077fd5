"""Imports every module that registers queries."""

from workload import cross_section  # noqa: F401
from workload import series_queries  # noqa: F401, E402
from workload import index_queries  # noqa: F401, E402
from workload import listing_queries  # noqa: F401, E402
from workload import text_queries  # noqa: F401, E402
from workload import profile_queries  # noqa: F401, E402
from workload import source_queries  # noqa: F401, E402
