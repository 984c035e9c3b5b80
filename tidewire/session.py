"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once a context."""
    context = spark.sparkContext
    if getattr(context, "_tidewire_shipped", False):
        return spark
    target = os.path.join(tempfile.mkdtemp(prefix="tidewire-"), "tidewire.zip")
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(target)
    context._tidewire_shipped = True
    return spark


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}
    return ship(builder.config(map=settings).getOrCreate())
