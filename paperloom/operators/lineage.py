"""Edges between papers, trees of topics, and set arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_norm(n: Column) -> Column:
    return F.regexp_replace(F.lower(n), "[^a-z0-9]", "")


def _said(readings: DataFrame) -> DataFrame:
    """``src, name``: the names that a note says it builds on or compares to, each once."""
    names = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("builds_on", "compares_to")))
    return readings.select(F.col("uid").alias("src"), F.explode(F.array_distinct(F.filter(F.transform(names, name_norm), lambda x: x != ""))).alias("name"))


def _names(papers: DataFrame) -> DataFrame:
    """``name, dst``: papers by their short names; those out of the library are none (a null scope is in)."""
    rows = papers.where(F.coalesce(F.col("sc"), F.lit("")) != "out") if "sc" in papers.columns else papers
    return rows.select(name_norm(F.col("n")).alias("name"), F.col("id").alias("dst")).where("name <> ''")


def edges(readings: DataFrame, papers: DataFrame) -> DataFrame:
    """``src, dst``: a note's names resolved to papers, every namesake one; a paper cites a name once and never itself."""
    return _said(readings).join(_names(papers), "name").where("src <> dst").select("src", "dst").distinct()


def context(found: DataFrame, papers: DataFrame, inside: DataFrame, mentions: int = 4, cites: int = 50) -> DataFrame:
    """Ids outside the scope that enough papers inside it build on."""
    n = found.join(inside.select(F.col("id").alias("src")), "src", "left_semi").groupBy("dst").agg(F.count_distinct("src").alias("n")).where(F.col("n") >= mentions)
    much = papers.where(F.col("c") >= cites).select("id")
    return n.select(F.col("dst").alias("id")).join(much, "id", "left_semi").join(inside.select("id"), "id", "left_anti")


def context_of(readings: DataFrame, papers: DataFrame, inside: DataFrame, mentions: int = 4, cites: int = 50, landmarks: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """``id`` of the papers outside a scope that its work stands on.

    A name is counted in the notes inside the scope, and its count holds for each namesake outside:
    so no note meets a paper, however common the name. ``mentions`` notes and
    ``cites`` citations make context; ``landmarks`` that the library has and ``ids`` picked by hand are it anyway.
    """
    scope = inside.select("id").distinct()
    n = _said(readings.join(scope.withColumnRenamed("id", "uid"), "uid", "left_semi")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= mentions)
    much = papers.where(F.coalesce("c", F.lit(0)) >= cites)
    found = _names(much).join(n, "name").select(F.col("dst").alias("id"))
    if landmarks is not None:
        found = found.union(landmarks.select("id").join(papers.select("id"), "id", "left_semi"))
    if ids is not None:
        found = found.union(ids.select("id"))
    return found.distinct().join(scope, "id", "left_anti")


def flatten_tree(spark, tree: list[dict]) -> DataFrame:
    """An outline as rows ``id, parent, depth, ord, path``; outlines are small and made by hand."""
    out, todo = [], [(n, None, 0, ()) for n in reversed(tree)]
    while todo:
        n, parent, depth, path = todo.pop()
        path = (*path, n["id"])
        out.append((n["id"], parent, depth, len(out), list(path)))
        todo += [(c, n["id"], depth + 1, path) for c in reversed(n.get("children", []))]
    return spark.createDataFrame(out, "id string, parent string, depth int, ord int, path array<string>")


def rollup(assigned: DataFrame, tree: DataFrame) -> DataFrame:
    """Papers of each node, its descendants' included: leaves' paths exploded."""
    rows = assigned.join(tree.select(F.col("id").alias("leaf"), "path"), "leaf")
    return rows.select("uid", F.explode("path").alias("node")).groupBy("node").agg(F.count_distinct("uid").alias("n"))


def union_minus(first: DataFrame, *others: DataFrame, minus: DataFrame) -> DataFrame:
    out = first
    for o in others:
        out = out.union(o)
    return out.distinct().join(minus, out.columns, "left_anti")


def landmark_status(expected: DataFrame, candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """What became of papers that have to be in the library."""
    rows = expected.join(candidates.select("id", "prefilter"), "id", "left").join(labels.select("id", "scope"), "id", "left")
    status = F.when(F.col("prefilter").isNull(), "missing").when(F.startswith("prefilter", F.lit("drop")), F.col("prefilter")).when(F.col("scope").isNull(), "unlabelled").when(F.col("scope") == "out", "out").otherwise("ok")
    return rows.withColumn("status", status)
