"""Giving executors the package, wherever the driver's Python found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once for each application: executors fetch it from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # the driver serves the file as long as it runs
    folder = Path(tempfile.mkdtemp(prefix="framelode-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, folder / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))
    _shipped.add(context.applicationId)
