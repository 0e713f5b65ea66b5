"""Query registry used by ``__spark_entry__``, ``bench.py`` and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    # Importing the catalog modules registers their queries.
    from preftable.plans import catalog  # noqa: F401
    from preftable.plans import catalog_batches  # noqa: F401
    from preftable.plans import catalog_scores  # noqa: F401
    from preftable.plans import catalog_io  # noqa: F401
    from preftable.plans import catalog_records  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    from preftable.plans.catalog import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    from preftable.plans.catalog import ORACLES

    return dict(ORACLES)
