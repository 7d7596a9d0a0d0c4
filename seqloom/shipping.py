"""Makes this package importable in the Python workers of any executor."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once per application, hand the package's modules to Spark's file server, from which executors fetch them."""
    context = spark.sparkContext
    if getattr(context, "_has_seqloom", False):
        return
    target = Path(tempfile.mkdtemp(prefix="seqloom-")) / "seqloom_modules.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(HERE.rglob("*.py")):
            out.write(p, p.relative_to(HERE.parent))
    context.addPyFile(str(target))
    context._has_seqloom = True


def shipped(query):
    """A query or stage whose first argument is the session, run with the package in the workers."""

    @functools.wraps(query)
    def run(spark, *rest):
        ship(spark)
        return query(spark, *rest)

    return run
