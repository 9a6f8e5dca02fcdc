"""Brings this package to the Python workers of a session that was started without it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch, unless the session says otherwise: a batch becomes Python objects of several times that size.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's files, once; does nothing if PYTHONPATH has it already. Bounds Arrow batches by bytes."""
    root = Path(__file__).resolve().parent
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False) or _started_with(root.parent):
        return spark
    archive = Path(tempfile.mkdtemp(prefix="corpusloom-ship-")) / "corpusloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._corpusloom_shipped = True
    return spark


def _started_with(path: Path) -> bool:
    """Whether this process, and so the JVM that it started, had the path from its start."""
    try:
        return str(path) in Path("/proc/self/environ").read_text(errors="replace").split("\0PYTHONPATH=")[1].split("\0")[0].split(":")
    except (OSError, IndexError):
        return False
