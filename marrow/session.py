"""Making the package known to the executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a session, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parent.parent
    key = spark.sparkContext.applicationId
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if key in _sent or str(root) in known:
        return
    folder = tempfile.mkdtemp(prefix="marrow-")  # Spark's file server hands it out from the driver
    shutil.copytree(root / "marrow", f"{folder}/tree/marrow", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/marrow", "zip", f"{folder}/tree"))
    shutil.rmtree(f"{folder}/tree")
    _sent.add(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. One of its own where that is unset, which only a session on one machine may have."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='marrow-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")
