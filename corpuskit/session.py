"""Session defaults, and the package on Python workers."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
#: Applications whose workers have been sent the package.
_SENT: set[str] = set()

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "corpuskit", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _found_by_workers() -> bool:
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    return any(os.path.realpath(p) == ROOT for p in [os.getcwd(), *filter(None, paths)])


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, which first sends this package to Python workers that would not find it by themselves.

    They find it where the driver started in the repository or names it in PYTHONPATH; elsewhere
    Spark hands a zip of it to every executor, once for an application.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        if not _found_by_workers() and context.applicationId not in _SENT:
            folder = tempfile.mkdtemp(prefix="corpuskit-")
            context.addPyFile(shutil.make_archive(os.path.join(folder, "corpuskit"), "zip", ROOT, "corpuskit"))
            _SENT.add(context.applicationId)
        return query(spark, sf_dir)

    return run
