"""Makes this package importable on executors that do not share the driver's folders."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends a zip of the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), "foliospark_sources.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent).as_posix())
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
