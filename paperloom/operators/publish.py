"""The tables of a published library: summary, points, cards, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import mart, trends
from paperloom.sources import versions

#: First year of the overview, most benchmarks listed (fixed values).
FIRST_YEAR, BENCHMARKS = 2010, 12


def headline(papers: DataFrame, board: DataFrame) -> DataFrame:
    """One row: papers, core, read, venues, authors, results and the verified share of these, to three decimals."""
    people = papers.select(F.explode("a").alias("author")).agg(F.count_distinct("author").alias("authors"))
    p = papers.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("sc") == "core").alias("core"), F.count_if(F.col("r") == 1).alias("read"), F.count("vn").alias("with_venue"))
    good = F.count_if(F.coalesce("ok", F.lit(False)))
    b = board.agg(F.count(F.lit(1)).alias("results"), F.round(good / F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias("verified"))
    return p.join(F.broadcast(people)).join(F.broadcast(b))  # three rows of one


def top_benchmarks(papers: DataFrame, top: int = BENCHMARKS) -> DataFrame:
    """The benchmarks that most core papers use; unlisted ones are left out."""
    rows = papers.where("sc = 'core'").select(F.explode("bm").alias("bench")).where(~F.startswith("bench", F.lit("other:")))
    return rows.groupBy("bench").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "bench").limit(top)


def points(papers: DataFrame, paradigms: DataFrame) -> DataFrame:
    """A point for each paper in scope: time, place of its paradigm, citations, name. ``paradigms`` is (ord, code); none comes last."""
    order = paradigms.select(F.col("code").alias("pd"), F.when(F.col("code") == "none", 10**6).otherwise(F.col("ord")).alias("place"))
    kept = papers.where(F.col("sc").isin("core", "adjacent") & (F.col("y") >= FIRST_YEAR))
    return kept.join(order, "pd", "left").select("id", F.round(trends.fractional_year(F.col("d"), F.col("y")), 2).alias("at"), F.coalesce("place", F.lit(10**6)).alias("place"), F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("n", F.lit("")).alias("n"))


def code_counts(papers: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """``code, label, n`` of core papers for each code of a dimension, in its order, codes without papers with 0."""
    values = F.explode(column) if dict(papers.dtypes)[column].startswith("array") else F.col(column)
    n = papers.where("sc = 'core'").select("id", values.alias("code")).distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return dimension.join(n, "code", "left").select("ord", "code", "label", F.coalesce("n", F.lit(0)).alias("n")).orderBy("ord")


def query_table(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``key, src, hits, core``: what each query of the harvest found, by source, best first; ``queries`` is (key, src)."""
    return queries.join(hits.select(F.col("query").alias("key"), "hits", "core"), "key", "left").select("key", "src", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("core", F.lit(0)).alias("core")).orderBy("src", F.col("core").desc(), "key")


def build(papers: DataFrame, board: DataFrame, excluded: DataFrame, paradigms: DataFrame) -> dict[str, DataFrame]:
    """The published tables by name; each is one plan over the mart."""
    return {
        "papers": papers.orderBy(F.coalesce("d", F.lit("")).desc(), F.col("id").desc()),
        "excluded": excluded,
        "leaderboard": board,
        "stats": mart.stats(papers),
        "headline": headline(papers, board),
        "years": papers.where(F.col("sc") == "core").groupBy("y", "pd").agg(F.count(F.lit(1)).alias("n")),
        "benchmarks": top_benchmarks(papers),
        "points": points(papers, paradigms),
    }


def write(tables: dict[str, DataFrame], folder: str, notes: DataFrame | None = None, files: int = 64) -> None:
    """A new version of the site: each table as JSON lines in a folder of its name; notes by id in ``files`` folders, so that one is found without the others.

    All of it becomes current at once, by the switch at the end, so no reader mixes two versions.
    """
    spark = next(iter(tables.values())).sparkSession if tables else notes.sparkSession
    version = versions.new_version(folder)
    for name, df in tables.items():
        df.write.json(f"{version}/{name}")
    if notes is not None:
        notes.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(files))).write.partitionBy("part").json(f"{version}/notes")
    versions.switch(spark, folder, version, files=files)


def read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One table of the current version."""
    return spark.read.schema(schema).json(f"{versions.current(spark, folder)}/{name}")


def read_note(spark: SparkSession, folder: str, uid: str, schema: str, files: int = 64) -> DataFrame:
    """One paper's note, from its own part alone."""
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(uid)), F.lit(files))).first()[0]
    return spark.read.schema(schema).json(f"{versions.current(spark, folder)}/notes/part={part}").where(F.col("uid") == uid)


def entries_file(papers: DataFrame, key: str = "key", bib: str = "bib") -> DataFrame:
    """``line``: all entries in order of their keys, set apart by blank lines."""
    return papers.orderBy(key).select(F.concat(F.col(bib), F.lit("\n")).alias("line"))


def shown(column: str, most: int) -> Column:
    return F.slice(F.col(column), 1, most)
