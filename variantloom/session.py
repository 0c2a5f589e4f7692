"""What a session needs once: the package on the Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, which need not share the driver's folders; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        path = shutil.make_archive(f"{tempfile.mkdtemp()}/variantloom", "zip", Path(__file__).resolve().parents[1], "variantloom")
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one in local mode if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/variantloom-checkpoints"
    return base.rstrip("/")


def workers(spark: SparkSession) -> int:
    """Tasks that run at a time."""
    return spark.sparkContext.defaultParallelism


#: Rows that a task of a wide step takes, on average.
ROWS_A_TASK = 500_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of a wide step over so many rows: as many as run at a time at least, and more as rows grow, so that none holds more."""
    return max(workers(spark), -(-rows // ROWS_A_TASK))


def set_workers(spark: SparkSession, n: int | None = None) -> int:
    """How many parts shuffles make from now on; by default as many as tasks run at a time, two at least."""
    n = n or max(2, workers(spark))
    spark.conf.set("spark.sql.shuffle.partitions", n)
    return n


def block_size(n: int, n_workers: int) -> int:
    """Rows of a block when n rows are dealt dynamically: three blocks a worker."""
    return max(1, -(-n // (3 * n_workers)))
