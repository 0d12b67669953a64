"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Only where that is unset and driver and executors are one process, as in tests, a
    temporary folder stands in for it, until the process ends. On a cluster executors would
    write to their own disks and the table would be read back short, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        folder = tempfile.mkdtemp(prefix="paperloom-")
        _own_folder.append("file://" + folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _own_folder[0]


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort, as the session may be gone by then."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        pass


_tables: dict[str, SparkSession] = {}


def _remove_all() -> None:
    for path, spark in list(_tables.items()):
        _remove(spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table ends the lineage, so a lost executor costs a reread and not a
    recomputation, and its real size lets the planner choose the next join. Plans made
    from the table outlive this frame, so tables go when the process ends; ``released``
    removes those of a finished job earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_remove_all)
    _tables[path] = spark
    return spark.read.schema(df.schema).parquet(path)


class released:
    """``with released(): ...`` removes at its end the tables that ``cut`` wrote inside."""

    def __enter__(self) -> None:
        self.before = set(_tables)

    def __exit__(self, *_) -> None:
        for path in set(_tables) - self.before:
            _remove(_tables.pop(path), path)
