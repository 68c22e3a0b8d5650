"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application; Spark's own file server hands them out."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="callweave-")) / "callweave_modules.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, f"{root.name}/{module.relative_to(root)}")
    sc.addPyFile(str(packed))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="callweave-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as reliable files: later stages, and re-runs after a lost executor, read these."""
    ship(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
