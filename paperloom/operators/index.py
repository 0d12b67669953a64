"""A BM25 index that is written once and asked many times.

Postings lie in buckets of terms; a term's postings are cut into blocks of falling weight,
and each block has its greatest weight and its years. A weight holds everything that does
not depend on the question: saturation, length and the paper's boost. A question reads the
buckets of its own terms. The first blocks give the k-th best score so far; a block whose
greatest weight cannot bring a paper to that score, with the best that the question's other
terms have, is never opened.

Texts are read once. A task inverts some papers at a time, so what is shuffled is a row for a
term of many papers, not one for each posting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import retrieval
from paperloom.sources import versions
from paperloom.sources.staging import cut, released

BUCKETS = 64
#: Postings of a block, and postings of one term that one task sorts, on average.
BLOCK, LOT = 256, 1 << 18
#: Tokens, and papers, that are inverted at once.
TOKENS, PAPERS = 1 << 21, 1 << 16
#: Postings that one task sorts into a bucket, on average.
WRITTEN = 1 << 22
SCHEMA = "term string, df long, lot int, block int, most double, low int, high int, ids array<{id}>, weights array<double>, years array<int>, bucket int"
#: Sums of the same parts in another order may differ by so much.
_EPS = 1e-9


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def runs(papers: DataFrame, weights: dict[str, float], k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """``term, n, p``: what some papers have of a term; ``papers`` has ``id, y, c, sc``, maybe ``r``, and the weighted fields.

    Papers without tokens have no postings.
    """
    read = F.coalesce(F.col("r") == 1, F.lit(False)) if "r" in papers.columns else F.lit(False)
    boost = retrieval.boost(F.col("c"), F.col("sc") == "core", read)
    sized = cut(retrieval.sized_terms(papers, weights, F.coalesce("y", F.lit(0)).cast("int").alias("y"), boost.alias("boost")), "terms")
    mean = sized.agg(F.avg("dl")).first()[0]

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _in_lots(batches):
            yield from _inverted(some, mean, k1, b)

    return cut(sized.mapInArrow(inverted, f"term string, n int, p array<struct<fall:double,id:{dict(papers.dtypes)['id']},y:int>>"), "runs")


def blocks(found: DataFrame, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """The index's rows of ``runs``.

    A term of very many papers is cut into lots first, each with its own falling
    blocks, so no task sorts much more than a lot.
    """
    often = found.groupBy("term").agg(F.sum("n").alias("often")).where(F.col("often") > LOT)  # no more rows than there are lots
    lot = F.pmod(F.xxhash64(F.lit("lot"), F.col("p")[0]["id"]), F.coalesce(F.ceil(F.col("often") / LOT), F.lit(1))).cast("int")
    dealt = found.join(F.broadcast(often), "term", "left").select("term", lot.alias("lot"), "often", "n", "p")
    df = F.coalesce("often", F.sum("n"))  # all runs of other terms are one lot
    falling = dealt.groupBy("term", "often", "lot").agg(df.alias("df"), F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    starts = F.sequence(F.lit(0), F.size("p") - 1, F.lit(block))
    each = falling.select("term", "df", "lot", F.posexplode(F.transform(starts, lambda i: F.slice("p", i + 1, block))).alias("block", "p"))  # ``block`` entries
    p = F.col("p")
    return each.select(
        "term", "df", "lot", "block", (-p[0]["fall"]).alias("most"), F.array_min(p["y"]).alias("low"), F.array_max(p["y"]).alias("high"),
        p["id"].alias("ids"), F.transform(p["fall"], lambda x: -x).alias("weights"), p["y"].alias("years"), _bucket(F.col("term"), buckets).alias("bucket"),
    )


def _in_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, until they have ``TOKENS`` tokens or ``PAPERS`` papers."""
    held, tokens, papers = [], 0, 0
    for batch in batches:
        held.append(batch)
        tokens, papers = tokens + len(batch["hits"].flatten()), papers + len(batch)
        if tokens >= TOKENS or papers >= PAPERS:
            yield pa.Table.from_batches(held)
            held, tokens, papers = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _inverted(papers: pa.Table, mean: float | None, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """One row for each term of some papers, with all its postings; ``fall`` is the weight below zero, so that sorting puts the greatest first."""
    papers = papers.combine_chunks()
    hits = papers["hits"].combine_chunks()
    each = hits.flatten()
    if not len(each):
        return
    terms = each.field("term").dictionary_encode()
    of = np.repeat(np.arange(len(papers), dtype=np.int64), hits.value_lengths().to_numpy(zero_copy_only=False))
    key = (terms.indices.to_numpy().astype(np.int64) << 32) | of
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf, key = np.add.reduceat(each.field("w").to_numpy()[order], first), key[first]
    term, paper = key >> 32, key & 0xFFFFFFFF
    length, boost = papers["dl"].to_numpy()[paper], papers["boost"].to_numpy()[paper]
    fall = -(tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)) * boost)
    begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    own = pa.array(paper)
    entries = pa.StructArray.from_arrays([pa.array(fall), papers["id"].combine_chunks().take(own), papers["y"].combine_chunks().take(own)], ["fall", "id", "y"])
    ends = np.append(begin, len(key))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)
    yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(term[begin])), pa.array(np.diff(ends).astype(np.int32)), lists], ["term", "n", "p"])


def write(papers: DataFrame, folder: str, weights: dict[str, float] | None = None, buckets: int = BUCKETS, block: int = BLOCK, stamp: int = 0) -> None:
    """A new version of the index, current once it is whole."""
    spark, version = papers.sparkSession, versions.new_version(folder)
    with released():
        found = runs(papers, weights or retrieval.FIELD_WEIGHTS)
        files = 1 + (found.agg(F.sum("n")).first()[0] or 0) // (buckets * WRITTEN)  # of a bucket; a term's lot is in one of them
        dealt = blocks(found, buckets, block).repartition(buckets * files, "bucket", F.pmod(F.xxhash64("term", "lot"), F.lit(files)))
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{version}/postings")
    versions.switch(spark, folder, version, papers=papers.count(), id=dict(papers.dtypes)["id"], buckets=buckets, stamp=stamp)


def refreshed(spark: SparkSession, source: str, folder: str, read=None, **how) -> bool:
    """Write the index anew if a file of ``source`` is newer than the one it was made of; whether it was."""
    stamp, held = versions.modified(spark, source), versions.read_pointer(spark, folder)
    if held and held.get("stamp") == stamp:
        return False
    write((read or spark.read.parquet)(source), folder, stamp=stamp, **how)
    return True


def opened(spark: SparkSession, folder: str, question: str) -> tuple[DataFrame, dict]:
    """The blocks of a question's terms, from their buckets alone, and what the index says of itself."""
    held = versions.read_pointer(spark, folder)
    terms = retrieval.query_terms(question)
    rows = spark.read.schema(SCHEMA.format(id=held["id"])).parquet(f"{folder.rstrip('/')}/{held['version']}/postings")
    asked = spark.createDataFrame([(x,) for x in terms], "term string").select(_bucket(F.col("term"), held["buckets"]).alias("b")).distinct()
    buckets = sorted(r["b"] for r in asked.collect())  # one for each term of a question at most
    return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)), held


def _postings(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    each = rows.select("term", "idf", F.explode(F.arrays_zip("ids", "weights", "years")).alias("p")).select("term", F.col("p.ids").alias("id"), (F.col("idf") * F.col("p.weights")).alias("part"), F.col("p.years").alias("y"))
    each = each.where(F.col("y") >= low) if low else each
    return each.where(F.col("y") <= high) if high else each


def needed(rows: DataFrame, papers: int, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """The blocks that hold all of the k best papers: those of the question's years that can reach the k-th score."""
    idf = F.log(1 + (papers - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = rows.withColumn("idf", idf)
    rows = rows.where(F.col("high") >= low) if low else rows
    rows = rows.where(F.col("low") <= high) if high else rows
    # what a paper has of first blocks is no more than its score, so the k-th of these is reached by k papers
    some = _postings(rows.where("block = 0"), low, high).groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.col("score").desc()).limit(k)
    kth = some.agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("kth"))
    best = rows.groupBy("term").agg(F.max(F.col("most") * F.col("idf")).alias("best"))
    others = best.agg(F.sum("best").alias("all"))
    bounded = rows.join(F.broadcast(best), "term").join(F.broadcast(others)).join(F.broadcast(kth))  # a row a term of the question; two rows of one
    return bounded.where(F.col("most") * F.col("idf") + F.col("all") - F.col("best") >= F.col("kth") * (1 - _EPS)).drop("best", "all", "kth")


def top(spark: SparkSession, folder: str, question: str, k: int = retrieval.RETRIEVED, low: int | None = None, high: int | None = None) -> DataFrame:
    """``id, score``: the k best papers of a question, as ``retrieval.bm25`` with the boost scores them; ties to the smaller id."""
    rows, held = opened(spark, folder, question)
    found = _postings(needed(rows, held["papers"], k, low, high), low, high).groupBy("id").agg(F.sum("part").alias("score"))
    return found.where("score > 0").orderBy(F.col("score").desc(), "id").limit(k)


def retrieve(papers: DataFrame, folder: str, question: str, k: int = retrieval.RETRIEVED, low: int | None = None, high: int | None = None) -> DataFrame:
    """``retrieval.retrieve`` from the index: pinned names, then the best papers; the same rows in the same order."""
    pins = retrieval.named(papers, question).select("id", F.lit(1).alias("pinned"))
    best = top(papers.sparkSession, folder, question, k + retrieval.NAMED, low, high)
    both = best.join(pins, "id", "full").withColumn("pinned", F.coalesce("pinned", F.lit(0)))
    rows, held = opened(papers.sparkSession, folder, question)
    # a pinned name has its own score, whatever its year and place
    own = _postings(rows.withColumn("idf", F.log(1 + (held["papers"] - F.col("df") + 0.5) / (F.col("df") + 0.5))), None, None).join(F.broadcast(pins.select("id")), "id").groupBy("id").agg(F.sum("part").alias("own"))
    both = both.join(F.broadcast(own), "id", "left").withColumn("score", F.coalesce("score", "own", F.lit(0.0))).drop("own")
    return papers.join(F.broadcast(both), "id").orderBy(F.col("pinned").desc(), F.col("score").desc(), "id").limit(k)  # k rows and a few
