"""Session helpers: shipping this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to every executor, once an application.

    Functions that run in Python workers are found there by module name, and a
    worker need not share the driver's path.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        place = tempfile.mkdtemp(prefix="loomspark-")  # executors may fetch it at any time until the end
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{place}/loomspark_package", "zip", here.parent, here.name))
        _shipped.add(app)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when the driver ends: under spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomspark-")  # one machine only
    folder = f"{base.rstrip('/')}/loomspark-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
