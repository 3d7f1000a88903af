"""Makes the library importable on executors that do not have it: Python functions there name its modules."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package once for each application; where it is installed already this changes nothing."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    folder = shared if shared.startswith("/") else None  # beside the checkpoints where that is a folder
    if folder:
        os.makedirs(folder, exist_ok=True)
    archive = os.path.join(tempfile.mkdtemp(prefix="tideglass-ship-", dir=folder), "tideglass.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _DONE.add(app)
