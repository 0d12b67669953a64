"""Mixing sources to target weights, in DataFrame functions only.

Two passes over the documents and no shuffle of texts: the first sums the words of each
source, the second joins the few rows of rates and decides every document by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``source, source_size, target, rate`` from rows ``source, size``.

    Sources by code point, null last, take the weights in turn. The targets share
    ``share`` times all sizes by weight; a target stops at ``ceiling`` times its source's
    size and what it leaves is shared anew by weight. That fixed point is
    ``min(ceiling * size, level * weight)`` for one level, found here in closed form from
    running sums over the sources ordered by the level at which each stops. One task sorts
    these rows: one for each source, never one for each document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    by_stop = Window.orderBy("stop", "nth")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", weight.cast("double"))
        .withColumn("most", (F.col("source_size") * ceiling).cast("double"))
        .withColumn("stop", F.col("most") / F.col("weight"))
        .withColumn("stopped", F.coalesce(F.sum("most").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("sharing", F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("stopped")) / F.col("sharing"))
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least("most", F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed alone: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: str = "mix-1") -> DataFrame:
    """Columns of ``docs`` and ``mix_size, mix_source_size, mix_target, mix_rate, mix_copies``.

    A document's copies are ``floor(rate)`` plus one if its hash falls below the rate's
    fraction, so each source's words have its target as their mean, no document is taken
    more than ``ceiling`` times and a rerun decides alike. A null text has size 0; a null
    source is a source of its own, the last; a null key is hashed by its text; rows that
    repeat a key repeat its decision. An empty table gives an empty table. Where ``docs``
    has a column of these five names, it is replaced; ``mixed_rows`` keeps all.
    """
    row = mixed_rows(docs, key, text, source, weights, share, ceiling, seed)
    return row.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED), *ADDED)


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: str = "mix-1") -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and the five columns of ``mix``: no names can clash."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), word_count(F.col(text)).alias("mix_size"))
    own = F.col("row")
    rates = cut(source_rates(sized.select(own[source].alias("source"), F.col("mix_size").alias("size")), weights, share, ceiling), "rates")
    rates = rates.select(F.col("source").alias("mix_of"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"))
    chance = unit_hash(F.coalesce(own[key].cast("string"), F.md5(F.coalesce(own[text], F.lit("")).cast("binary"))), seed)
    whole = F.floor("mix_rate")
    copies = (whole + F.when(chance < F.col("mix_rate") - whole, 1).otherwise(0)).cast("int")
    return sized.join(rates, own[source].eqNullSafe(F.col("mix_of")), "left").withColumn("mix_copies", copies).select("row", *ADDED)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` as often as its copies say, without the columns that ``mix`` added."""
    own = [c for c in mixed.columns if c not in ADDED]
    return mixed.select(*own, F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))).select(*own)


def repeat(docs: DataFrame, **how) -> DataFrame:
    """Each row of ``docs`` as often as ``mix`` says, with all its columns, whatever their names, and no others."""
    mixed = mixed_rows(docs, **how)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op2."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((nth - 1) % 3 + 1)::INT] AS weight, (source_size * 2)::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
r AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM r)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
