"""What jobs need of the session: the package on the executors, and a shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors of this application, once; python workers import the functions that tasks name."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once under spark.checkpoint.dir (a temporary folder where that is unset) and read back: the cut of an iteration's lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/specgrain-checkpoints"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int = 16384) -> DataFrame:
    """df by hash of key in partitions of about so many rows, at least one a core, which Spark doesn't put together again: for short rows that the next step makes long or many."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, key)
