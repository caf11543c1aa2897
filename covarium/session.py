"""Sessions: configuration for local runs, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_covarium_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="covarium-")) / "covarium.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, Path(PACKAGE.name) / source.relative_to(PACKAGE))
    context.addPyFile(str(path))
    context._covarium_shipped = True


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for one machine: adaptive execution, Arrow and as many shuffle partitions as cores."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores).replace("*", "8"),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("covarium")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
