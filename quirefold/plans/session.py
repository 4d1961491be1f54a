"""Session helpers: the shared scratch folder, cutting lineage through it, shipping this package."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session that names none (tests, a laptop) gets a temporary folder, made once
    and remembered in the same setting. Executors of a cluster could not see such a folder,
    so there the setting must be given.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share ({master})")
        folder = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


#: Seconds between two releases of what finished jobs hold.
RELEASE_S = 2.0
_RELEASED = {"at": 0.0}


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and plans of jobs whose results are written.

    Spark's cleaner acts on what the driver's garbage collection finds unreachable, and a
    driver that only plans may go without one for half an hour; a loop of many small jobs
    then keeps the files of all its rounds on disk and their plans in memory.
    """
    now = time.monotonic()
    if now - _RELEASED["at"] >= RELEASE_S:
        gc.collect()  # handles of frames that Python no longer uses
        spark.sparkContext._jvm.System.gc()
        _RELEASED["at"] = time.monotonic()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The result has no lineage behind it: a lost executor costs the re-read of a
    file, not the recomputation of what led to it, and every later use sees the
    same rows in the same files. Shuffles that only led to it may go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    _release(spark)  # what led to earlier results, before the next job needs the room
    df.write.parquet(path)
    _release(spark)
    return spark.read.schema(schema).parquet(path)


def spread(rows: DataFrame, *by: str, each: int = 1_000_000) -> DataFrame:
    """``rows`` by key in tasks of some ``each`` rows, and no fewer tasks than a shuffle has.

    Left to itself a shuffle joins parts up to a size of compressed bytes, of which narrow rows
    fill a task's memory many times over when they are sorted.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
    return rows.repartition(tasks, *by)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context.

    Column functions that keep a cache in their worker are pickled by reference, so
    workers must be able to import them. Spark sends the archive to each executor.
    """
    context = spark.sparkContext
    if getattr(context, "_quirefold_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="quirefold-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    context._quirefold_shipped = True
