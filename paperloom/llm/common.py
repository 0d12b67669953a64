"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.staging import cut, shared_folder

__all__ = ["WORD", "bounded_batches", "cut", "fresh", "join_skewed", "shared_folder", "table", "word_count"]

#: Code points that end a word: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than one in so many rows; there are at most as many hot keys.
HOT = 1000


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """At most ``rows`` whole texts a batch on the way to Python.

    Spark reads this setting when a plan runs, so it has to outlive the call that returns
    the plan; a session that has set it itself keeps its own value.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column in ``taken`` has, in any case."""
    used, out = {x.lower() for x in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def join_skewed(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key``, whatever share of ``rows`` a key has.

    Keys with more than one in ``HOT`` rows are at most ``HOT`` keys; their number is all
    that is broadcast. Their rows are dealt over as many salts as they have thousandths of
    all rows, and their rows of the table copied as often: two thousand copies in all at
    most. Rows without a key are not shuffled. ``rows`` is read several times, so it should be a
    written table. ``how`` is inner or left.
    """
    total = rows.count()
    out = rows.join(table, key, how)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HOT > total + HOT) if total > HOT else None
    often = counts.limit(HOT).collect() if total > HOT else []  # a table of at most HOT rows is no task's burden
    if not often and how == "inner":
        return out
    known = rows.where(F.col(key).isNotNull())
    if often:
        salt, copies = fresh({*rows.columns, *table.columns}, "salt", "copies")
        hot = F.broadcast(rows.sparkSession.createDataFrame([(k, -(-n * HOT // total)) for k, n in often], f"`{key}` {dict(rows.dtypes)[key]}, {copies} int"))
        dealt = known.join(hot, key).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.col(copies)).cast("int")).drop(copies)
        each = table.join(hot, key).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop(copies)
        out = dealt.join(each, [key, salt], how).drop(salt).select(*out.columns)
        out = out.union(known.join(hot, key, "left_anti").join(table, key, how).select(*out.columns))
    elif how == "left" and total > HOT:
        out = known.join(table, key, how)
    else:
        return out
    if how == "left":
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key]
        out = out.select(*rows.columns, *(c for c in table.columns if c != key)).union(rows.where(F.col(key).isNull()).select(*rows.columns, *nothing))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
