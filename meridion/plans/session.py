"""What a session needs: the package on its executors, and a folder that all of them share."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once an application; they may have no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(importlib.util.find_spec("meridion").origin).parent
    archive = Path(tempfile.mkdtemp(prefix="meridion-")) / "meridion.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("meridion") / path.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a private one only in a local session without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meridion-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``, in the shared folder if the session names no other."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
