"""Sending this package to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, so that Python workers import the package wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    keep = tempfile.mkdtemp(prefix="modloom-")
    with tempfile.TemporaryDirectory() as tmp:
        shutil.copytree(root / "modloom", Path(tmp, "modloom"), ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(os.path.join(keep, f"modloom_{uuid.uuid4().hex[:8]}"), "zip", tmp)
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)
