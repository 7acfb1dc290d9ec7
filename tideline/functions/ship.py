"""Sends this package to the executors, so that functions in Python find it there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application. The archive holds the package's sources only."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="tideline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver while the application runs
    path = Path(folder) / "tideline_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)
