"""What an answer to a question is made of: board rows, leaders' papers, overview, context text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import as_text, bench_norm, label, metrics_text, percent
from paperloom.operators import board

# ---- fixed values --------------------------------------------------------------------
KEY_METRICS = ("SR", "SPL", "GP", "RGS", "Success")
TOP, PER_PARADIGM, LEADERS, FEWEST, RETRIEVED = 12, 6, 8, 8, 24
INSIGHT, RESULTS, ABSTRACT = 500, 500, 700
# ----------------------------------------------------------------------------------------


def _stands_in(question: str, name: Column) -> Column:
    quoted = F.concat(F.lit(r"(?<![a-z0-9-])"), F.regexp_replace(F.lower(name), r"([^a-z0-9 ])", r"\\$1"), F.lit(r"(?![a-z0-9-])"))
    return F.rlike(F.lit(f" {question.lower()} "), quoted)


def bench_of(question: str, rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``bench``: the benchmark that a question means, one row or none.

    The longest name that stands in it as a whole; an alias in its letters and digits
    wins if it is longer, or as long and of a larger board; if there is neither, a name of
    four letters and digits or more in them, at last without its version.
    """
    letters = bench_norm(F.lit(question))
    n = rows.where("bench is not null").groupBy("bench").agg(F.count(F.lit(1)).alias("n")).withColumn("norm", bench_norm(F.col("bench")))
    size = F.length("norm")
    whole = n.where(_stands_in(question, F.col("bench"))).orderBy(F.length("bench").desc(), "bench").limit(1).select("bench", size.alias("size"), "n", F.lit(1).alias("kind"))
    via = aliases.select(bench_norm(F.col("alias")).alias("alias"), F.col("name").alias("bench")).join(n, "bench").where(F.contains(letters, F.col("alias")))
    via = via.orderBy(F.length("alias").desc(), "alias").limit(1).select("bench", F.length("alias").alias("size"), "n", F.lit(0).alias("kind"))
    plain = F.regexp_replace("norm", "v[0-9]$", "")
    exact = n.where((size >= 4) & F.contains(letters, F.col("norm"))).select("bench", size.alias("size"), "n", F.lit(2).alias("kind"))
    loose = n.where((size >= 4) & F.contains(letters, plain)).select("bench", F.length(plain).alias("size"), "n", F.lit(3).alias("kind"))
    every = reduce(DataFrame.union, [whole, via, exact, loose])
    group = F.when(F.col("kind") < 2, 0).otherwise(F.col("kind"))
    return every.orderBy(group, F.col("size").desc(), F.col("n").desc(), F.col("kind").desc(), "bench").limit(1).select("bench")


def split_of(question: str, rows: DataFrame) -> DataFrame:
    """``split``: the longest split named in the question, else the most frequent one, of equals the first by ``_seq``."""
    n = rows.where("split <> ''").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("seen"))
    spaced = F.array_join(F.transform(F.split(F.lower("split"), "-"), lambda w: F.regexp_replace(w, r"([^a-z0-9 ])", r"\\$1")), "[- ]?")
    named = F.rlike(F.lit(question.lower()), F.concat(F.lit("(?<![a-z0-9])"), spaced, F.lit("(?![a-z0-9])")))
    return n.withColumn("named", named).orderBy(F.col("named").desc(), F.when(F.col("named"), F.length("split")).otherwise(0).desc(), F.col("n").desc(), "seen").limit(1).select("split")


def board_rows(question: str, rows: DataFrame, aliases: DataFrame, top: int = TOP, per_paradigm: int = PER_PARADIGM, metrics: tuple[str, ...] = KEY_METRICS) -> DataFrame:
    """Best results on the benchmark that a question names: the ``top`` of all and of each paradigm.

    ``rows`` are board rows with ``id, method, bench, split, eval_set, pd, m, ok, audit_ok,
    audit_std, cmp, priv, extra, _seq``. Usable rows of the full set on the split meant;
    of each paper and method the best. Adds ``metric, value, comparable``.
    """
    mine = rows.join(F.broadcast(bench_of(question, rows, aliases)), "bench")
    judged = board.comparable(mine.withColumn("__set", F.col("eval_set")).withColumn("eval_set", F.lit("full"))).withColumn("eval_set", F.col("__set")).drop("__set")
    full = judged.where((F.coalesce("eval_set", F.lit("")) != "subset") & board.usable(F.col("ok"), F.col("audit_ok"), F.col("m")))
    full = full.join(F.broadcast(split_of(question, full)), "split")
    there = full.agg(*(F.bool_or(F.map_contains_key("m", F.lit(k))).alias(k) for k in metrics))
    chosen = there.select(F.coalesce(*(F.when(F.col(k), F.lit(k)) for k in metrics)).alias("metric")).where("metric is not null")
    full = full.join(F.broadcast(chosen))
    said = F.regexp_replace(F.try_element_at("m", F.col("metric")), "%$", "")
    full = full.withColumn("value", F.coalesce(percent(F.col("metric"), said), F.lit(-1.0)))
    best = Window.partitionBy("id", "method").orderBy(F.col("value").desc(), "_seq")
    ranked = full.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth")
    order = [F.col("value").desc(), F.col("_seq")]
    everywhere = ranked.orderBy(*order).limit(top)
    each = board.top_per_group(ranked, ["pd"], order, per_paradigm).drop("rank")
    return everywhere.unionByName(each).dropDuplicates(["_seq"]).orderBy(*order)


def with_leaders(found: DataFrame, leaders: DataFrame, papers: DataFrame, k: int = RETRIEVED, most: int = LEADERS, least: int = FEWEST) -> DataFrame:
    """Papers of an answer in order: those found, of which ``least`` at least, then the board's leaders that are not among them.

    ``found`` is (id, rank), ``leaders`` (id, place); at most ``most`` places are looked at.
    """
    lead = leaders.where(F.col("place") <= most).groupBy("id").agg(F.min("place").alias("place")).join(papers.select("id"), "id", "left_semi").join(found.select("id"), "id", "left_anti")
    n = lead.agg(F.count(F.lit(1)).alias("n"))
    kept = found.join(F.broadcast(n)).where(F.col("rank") <= F.greatest(F.lit(least), F.lit(k) - F.col("n"))).select("id", F.lit(0).alias("part"), F.col("rank").alias("at"))
    return kept.union(lead.select("id", F.lit(1), "place")).orderBy("part", "at")


def overview(papers: DataFrame, low: int = 0, high: int = 9999, years: int = 10, per_group: int = 4, recent: int = 8, surveys: int = 5) -> dict[str, DataFrame]:
    """For a broad question, over the core papers of its years: counts, leaders, the most cited new ones and surveys."""
    core = papers.where((F.col("sc") == "core") & F.coalesce("y", F.lit(0)).between(low, high))
    seen = core.where("y > 0").select("y").distinct().orderBy(F.col("y").desc()).limit(years)
    last = seen.agg(F.max("y").alias("last"))
    order = [F.coalesce("c", F.lit(0)).desc(), F.col("id").asc()]
    return {
        "counts": core.join(F.broadcast(seen), "y").groupBy("y", "pd").agg(F.count(F.lit(1)).alias("n")),
        "leaders": board.top_per_group(core, ["pd"], order, per_group),
        "recent": core.join(F.broadcast(last)).where(F.col("y") >= F.col("last") - 1).orderBy(*order).limit(recent),
        "surveys": core.where(F.array_contains(F.coalesce("ct", F.array().cast("array<string>")), "survey")).orderBy(*order).limit(surveys),
    }


def overview_ids(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [parts[k].select("id") for k in ("leaders", "recent", "surveys")]).distinct()


def context_lines(papers: DataFrame) -> DataFrame:
    """``id, line``: a paper as a writer reads it, with its head, idea, insight, and results or abstract.

    Papers have the columns of the wide table and ``ki, ins, res`` of their note.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tasks = F.coalesce(F.nullif(F.array_join(F.coalesce("tk", F.array().cast("array<string>")), ", "), F.lit("")), F.lit("-"))
    head = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), label(F.col("n"), F.col("t")), F.lit(" ("), F.coalesce("vn", F.lit("preprint")), F.lit(" "), F.col("y").cast("string"))
    head = F.concat(head, F.lit("; paradigm "), text("pd"), F.lit("; tasks "), tasks, F.lit("; citations "), F.coalesce("c", F.lit(0)).cast("string"), F.lit(")"))
    body = F.when(text("ki") != "", text("ki")).otherwise(text("tl"))
    insight = F.when(text("ins") != "", F.concat(F.lit(" Insight: "), F.substring("ins", 1, INSIGHT))).otherwise("")
    rest = F.when(text("res") != "", F.concat(F.lit(" Results: "), F.substring("res", 1, RESULTS))).when(text("ki") == "", F.concat(F.lit(" Abstract: "), F.substring(text("ab"), 1, ABSTRACT))).otherwise("")
    return papers.select("id", F.concat(head, F.lit("\n"), body, insight, rest).alias("line"))


def result_lines(rows: DataFrame) -> DataFrame:
    """``id, line``: a board row as a writer reads it."""
    zero = F.when(F.coalesce("zs", F.lit(False)), ", zero-shot").otherwise("")
    apart = F.when(~F.coalesce("comparable", F.lit(True)), ", NOT directly comparable").otherwise("")
    return rows.select("id", F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] "), F.coalesce("method", F.lit("")), F.lit(" ("), F.col("y").cast("string"), F.lit(", "), F.col("pd"), zero, apart, F.lit("): "), metrics_text(F.col("m"))).alias("line"))


def citable(*ids: DataFrame) -> DataFrame:
    """All ids that an answer may cite."""
    return reduce(DataFrame.union, [d.select("id") for d in ids]).distinct()


def without_unknown(answer: Column, known: Column) -> Column:
    """An answer without brackets that name what is not among its sources."""
    said = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9:./-]+)\]"), 1))
    bad = F.filter(said, lambda x: ~F.array_contains(known, x))
    return F.aggregate(bad, answer, lambda t, x: F.replace(t, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))


def cache_key(*parts: str) -> str:
    """The key that an answer is remembered by: question and everything that it rests on."""
    import hashlib

    return hashlib.sha1("\u001f".join(re.sub(r"\s+", " ", p).strip() for p in parts).encode()).hexdigest()[:16]


__all__ = ["as_text", "bench_of", "board_rows", "cache_key", "citable", "context_lines", "overview", "overview_ids", "result_lines", "split_of", "with_leaders", "without_unknown"]
