"""Tables in versions, and a log that says which of them holds.

A version is a folder that is written once and never changed. ``commit`` adds a numbered
file to the log, the last step of every write: a rename to a name that nobody has, which a file
system does at once or not at all, so of two writers one fails. Who reads meanwhile
finds the old version whole, and a job that fails before leaves a folder that nothing
points to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

LOG = "_log"
#: Versions, and entries of the log, that stay besides the current one, for readers that have begun.
KEPT = 2


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = p(path)
    return p, where.getFileSystem(conf), conf


def _numbers(spark: SparkSession, root: str) -> list[int]:
    p, files, _ = _hadoop(spark, root)
    return sorted(int(s.getPath().getName()[:-5]) for s in files.globStatus(p(f"{root}/{LOG}/[0-9]*.json")) or [])


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """What was committed last; None where nothing was."""
    p, files, _ = _hadoop(spark, root)
    while numbers := _numbers(spark, root):
        where = p(f"{root}/{LOG}/{numbers[-1]:020}.json")
        if not files.exists(where):
            continue  # newer ones have come and this one is gone
        stream = files.open(where)
        try:
            return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
    return None


def commit(spark: SparkSession, root: str, content: dict) -> None:
    """The next entry of the log; fails where another writer was faster."""
    p, files, conf = _hadoop(spark, root)
    numbers = _numbers(spark, root)
    number = numbers[-1] + 1 if numbers else 0
    beside, where = p(f"{root}/{LOG}/.{uuid.uuid4().hex}"), p(f"{root}/{LOG}/{number:020}.json")
    out = files.create(beside, True)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
    context.rename(files.makeQualified(beside), files.makeQualified(where), options)
    for old in numbers[:-KEPT]:
        files.delete(p(f"{root}/{LOG}/{old:020}.json"), False)


def remove(spark: SparkSession, path: str) -> None:
    p, files, _ = _hadoop(spark, path)
    files.delete(p(path), True)


def new_version(root: str) -> str:
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def switch(spark: SparkSession, root: str, version: str, **more) -> None:
    """From now on ``version``, a folder below ``root``, is current; what is older than the last ``KEPT`` goes."""
    root = root.rstrip("/")
    before = read_pointer(spark, root) or {}
    older = [*before.get("older", []), *([before["version"]] if before.get("version") else [])]
    commit(spark, root, {"version": version.removeprefix(f"{root}/"), "older": older[-KEPT:], **more})
    for name in older[:-KEPT]:
        remove(spark, f"{root}/{name}")


def current(spark: SparkSession, path: str) -> str:
    """The current version's folder; ``path`` itself where there are no versions."""
    found = read_pointer(spark, path)
    return f"{path.rstrip('/')}/{found['version']}" if found and found.get("version") else path


def modified(spark: SparkSession, path: str) -> int:
    """When the newest file under a path was written, in milliseconds; 0 if there is none."""
    p, files, _ = _hadoop(spark, path)
    where = p(path)
    if not files.exists(where):
        return 0
    found, newest = files.listFiles(where, True), 0
    while found.hasNext():
        newest = max(newest, found.next().getModificationTime())
    return newest
