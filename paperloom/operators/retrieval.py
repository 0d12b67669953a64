"""BM25 over weighted fields, pinned names, board and overview for a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import as_text, bench_norm, tokens

# ---- fixed values ------------------------------------------------------------------
FIELD_WEIGHTS = {"n": 3.0, "t": 2.0, "tl": 1.5, "bm": 1.5, "ab": 1.0, "ki": 1.2, "ins": 0.8, "pr": 0.6}
K1, B, RETRIEVED, NAMED = 1.2, 0.75, 24, 5
STOP = (
    "a an the of in on for to and or with without by from at as is are was were be been being it its this that these those which what who whom whose how why when where do does did can"
    " could should would will may might than then there their they them we our you your i me my about into over under between across via vs versus using use used based any all some most"
    " more less much many few each other such not no yes paper papers work works method methods approach approaches model models recent latest best state art sota"
).split()
# ------------------------------------------------------------------------------------


def _weighted(w: float):
    return lambda x: F.struct(x.alias("term"), F.lit(w).alias("w"))


def _fields(docs: DataFrame, weights: dict[str, float]) -> list[tuple[Column, float]]:
    """Tokens and weight of each field that the table has; arrays are joined."""
    kinds = dict(docs.dtypes)
    text = lambda c: as_text(F.col(c)) if kinds[c].startswith("array") else F.col(c)
    return [(F.filter(tokens(text(c)), lambda x: ~x.isin(STOP)), w) for c, w in weights.items() if c in kinds]


def postings(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``id, term, tf``: weighted term frequencies over the fields there are."""
    parts = [F.transform(x, _weighted(w)) for x, w in _fields(docs, weights)]
    return docs.select("id", F.explode(F.flatten(F.array(*parts))).alias("x")).groupBy("id", "x.term").agg(F.sum("x.w").alias("tf"))


def document_frequency(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``term, df``: a document's distinct terms are found in its row, so only counts are shuffled."""
    terms = F.array_distinct(F.flatten(F.array(*(x for x, _ in _fields(docs, weights)))))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(question: str) -> list[str]:
    """Distinct terms of a question; parts of hyphenated ones are added, years and stop words are left out."""
    import re

    found = re.findall(r"[a-z0-9][a-z0-9+.\-]*[a-z0-9+]|[a-z0-9]", question.lower())
    found += [p for t in found if "-" in t for p in t.split("-")]
    return sorted({t for t in found if t and t not in STOP and not re.fullmatch(r"(?:19|20)\d\d", t)})


def sized_terms(docs: DataFrame, weights: dict[str, float], *keep: str | Column) -> DataFrame:
    """``id, keep, dl, hits``: each document's weighted length and its weighted tokens; a text is read once for both."""
    fields = _fields(docs, weights)
    found = [(F.col(f"__f{i}"), w) for i, (_, w) in enumerate(fields)]
    apart = docs.select("id", *keep, *(x.alias(f"__f{i}") for i, (x, _) in enumerate(fields)))
    length = reduce(lambda a, b: a + b, [F.size(x) * F.lit(w) for x, w in found])
    return apart.withColumns({"dl": length, "hits": F.flatten(F.array(*(F.transform(x, _weighted(w)) for x, w in found)))}).drop(*(f"__f{i}" for i in range(len(fields))))


def bm25(docs: DataFrame, question: str, weights: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """``id, score`` of documents that hold a term of the question.

    Lengths are of all documents and counted within each row; only the question's terms
    are exploded, so what is shuffled is as small as the question.
    """
    terms = query_terms(question)
    fields = _fields(docs, weights)
    length = reduce(lambda a, b: a + b, [F.size(x) * F.lit(w) for x, w in fields])
    sized = docs.select("id", length.alias("dl"), F.flatten(F.array(*(F.transform(F.filter(x, lambda v: v.isin(terms)), _weighted(w)) for x, w in fields))).alias("hits"))
    every = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    some = sized.select("id", "dl", F.explode("hits").alias("x")).groupBy("id", "dl", "x.term").agg(F.sum("x.w").alias("tf"))
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = some.join(df, "term").join(F.broadcast(every))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(part).alias("score"))


def boost(cites: Column, core: Column, read: Column) -> Column:
    return 1 + 0.06 * F.log1p(F.coalesce(cites, F.lit(0))) + F.when(core, 0.15).otherwise(0.0) + F.when(read, 0.1).otherwise(0.0)


def named(papers: DataFrame, question: str, limit: int = NAMED) -> DataFrame:
    """Papers whose short name stands as a whole word in the question, most cited first."""
    name = F.lower(F.trim("n"))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])"), F.regexp_replace(name, r"([^a-z0-9 ])", r"\\$1"), F.lit(r"(?![a-z0-9])"))
    return papers.where((F.length(name) >= 3) & F.contains(F.lit(question.lower()), name)).where(F.rlike(F.lit(question.lower()), quoted)).orderBy(F.col("c").desc(), "id").limit(limit)


def retrieve(papers: DataFrame, question: str, weights: dict[str, float] | None = None, k: int = RETRIEVED, low: int | None = None, high: int | None = None) -> DataFrame:
    """Pinned names, then the best by boosted BM25 inside the question's years, an unknown one being 0; a top-k."""
    score = bm25(papers, question, weights or FIELD_WEIGHTS)
    pins = named(papers, question).select("id", F.lit(1).alias("pinned"))
    rows = papers.join(score, "id", "left").join(pins, "id", "left")
    rows = rows.withColumn("pinned", F.coalesce("pinned", F.lit(0))).where((F.col("score") > 0) | (F.col("pinned") == 1))
    if low:
        rows = rows.where((F.coalesce("y", F.lit(0)) >= low) | (F.col("pinned") == 1))
    if high:
        rows = rows.where((F.coalesce("y", F.lit(0)) <= high) | (F.col("pinned") == 1))
    final = F.coalesce("score", F.lit(0.0)) * boost(F.col("c"), F.col("sc") == "core", F.coalesce(F.col("r") == 1, F.lit(False)) if "r" in papers.columns else F.lit(False))
    return rows.withColumn("score", final).orderBy(F.col("pinned").desc(), F.col("score").desc(), "id").limit(k)


def bench_of(question: str, benches: DataFrame, aliases: DataFrame) -> DataFrame:
    """The benchmark a question means: the longest name or alias in it, then the larger board.

    ``benches`` is (bench, n), ``aliases`` (alias, bench). One row or none.
    """
    q, spaced = F.lit(question), F.lit(" " + question.lower() + " ")
    whole = F.rlike(spaced, F.concat(F.lit(r"(?<![a-z0-9])"), F.regexp_replace(F.lower("bench"), r"([^a-z0-9 ])", r"\\$1"), F.lit(r"(?![a-z0-9])")))
    direct = benches.where(whole).select("bench", F.length("bench").alias("size"), "n")
    by_alias = aliases.join(benches, "bench").where(F.contains(bench_norm(q), bench_norm(F.col("alias")))).select("bench", F.length(bench_norm(F.col("alias"))).alias("size"), "n")
    return direct.union(by_alias).orderBy(F.col("size").desc(), F.col("n").desc(), "bench").limit(1)


def overview(papers: DataFrame, years: int = 10, per_group: int = 4, recent: int = 8) -> dict[str, DataFrame]:
    """For a broad question: counts a year and paradigm, leaders of each, the newest."""
    from paperloom.operators.board import top_per_group

    last = papers.agg(F.max("y").alias("last"))
    rows = papers.join(F.broadcast(last)).where(F.col("y") > F.col("last") - years)
    fresh = rows.where(F.col("y") >= F.col("last") - 1)
    return {
        "counts": rows.groupBy("y", "pd").agg(F.count(F.lit(1)).alias("n")),
        "leaders": top_per_group(rows, ["pd"], [F.col("c").desc(), F.col("id")], per_group),
        "recent": fresh.orderBy(F.col("c").desc(), "id").limit(recent),
    }


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``id, name``: whole-word mentions of names of any number of words.

    Texts and names meet by equality of whole names with a text's runs of as many words, so
    no text is compared with all names, and none is copied for each of its words.
    """
    n = names.select("name", tokens(F.col("name")).alias("w")).where(F.size("w") > 0).select("name", F.size("w").alias("k"), F.array_join("w", " ").alias("said")).distinct()
    lengths = sorted(r["k"] for r in n.select("k").distinct().collect())  # how many words a name has
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")) if k > 1 else F.col("w")
    each = [F.when(F.size("w") >= k, F.array_distinct(runs(k))).otherwise(F.array().cast("array<string>")) for k in lengths] or [F.array().cast("array<string>")]
    x = texts.select("id", tokens(F.col("text")).alias("w")).select("id", F.explode(F.flatten(F.array(*each))).alias("said"))
    return x.join(n, "said").select("id", "name").distinct()
