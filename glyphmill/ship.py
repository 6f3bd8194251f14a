"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once per application, through Spark's own
    file distribution, unless their PYTHONPATH has it already."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="glyphmill-")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in (root / "glyphmill").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(path)
    _SHIPPED[sc.applicationId] = path
