"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir; under the temporary folder where that is unset, in local mode alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/credence"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_credence_shipped", False):
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="credence-")) / "credence.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(at))
    sc._credence_shipped = True
