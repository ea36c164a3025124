"""Sessions: shipping this package to the executors, batches that fit their memory, the folder that all share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: texts are long, and a worker holds a batch several times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(spark: SparkSession) -> None:
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Lets Python workers on all executors import this package, once an application."""
    small_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="strandline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file until then
    path = os.path.join(folder, "strandline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(os.path.join(_ROOT, "strandline")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and re.match(r"local($|\[)", spark.sparkContext.master):
        return "file://" + os.path.join(tempfile.gettempdir(), "strandline-shared")
    if found is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found
