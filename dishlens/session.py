"""Session defaults for local runs; a cluster brings its own session and the jobs only read from it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, which need not have it installed; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="dishlens-"), f"{os.path.basename(here)}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, driver_memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dishlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="dishlens-"))
        .getOrCreate()
    )
