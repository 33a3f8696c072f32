"""Makes this package importable on the executors, however the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="holdfast-code-")) / "holdfast_code.zip"
    with zipfile.ZipFile(to, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)
