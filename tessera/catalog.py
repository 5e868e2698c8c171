"""All registered queries of the library proper, by name."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .plans import tables  # noqa: F401 (registers its queries)
from .plans.queries import ORACLE_SQL, QUERIES, ana_daily

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "ship", "shipped"]
Query = Callable[[SparkSession, str], DataFrame]
ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, where neither their path nor their folder has it."""
    app = spark.sparkContext.applicationId
    known = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or str(ROOT) in known:
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))


def shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, days without events included."""
    ship(spark)
    return ana_daily(spark, sf_dir)
