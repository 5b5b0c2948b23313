"""Getting this package's code to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of rows that are sent to a Python worker at once: with very long texts, numbers of rows are no bound.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, once for each application; Arrow functions import it there."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="pairwave-code-")) / "pairwave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """df stored in the folder of spark.checkpoint.dir, which all executors share; a temporary one only in local mode where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="pairwave-"))
    return df.checkpoint()
