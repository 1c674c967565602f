"""Making the package importable in Python workers, and folders that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless workers find it already: through PYTHONPATH, or because
    they start in its folder."""
    root, sc = Path(__file__).resolve().parent.parent, spark.sparkContext
    found = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd()]
    if root in found or getattr(sc, "_paperloom_shipped", False):
        return
    folder = tempfile.mkdtemp()
    tree = Path(folder) / "tree"
    shutil.copytree(root / "paperloom", tree / "paperloom", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder) / "paperloom"), "zip", tree))
    sc._paperloom_shipped = True


def shared_folder(spark: SparkSession, base: str | None = None) -> str:
    """The name of a new folder below ``base``, by default below ``spark.checkpoint.dir``; a local temporary folder only where that is
    unset and Spark is local."""
    sc = spark.sparkContext
    base = base or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir, or give a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
