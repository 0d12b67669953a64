"""How far each source of a language is from the others, and by which terms.

Terms are counted once, before any shuffle, by the tasks that read the documents; postings
(a language's term with its sources' counts) are all that is read after that. A pair of sources
is summed from three parts: terms of either source alone need only that source's counts of
counts, and only terms of both are looked up in the postings. The terms that set a source
apart are searched by bounds: a bucket holds a group's terms of one count and of about one
frequency in the language, its extreme frequencies bound what any of its terms
reaches, and buckets are evaluated best first until no other can reach the last rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut

#: What Spark's and DuckDB's patterns say; the table below leaves the same in UTF-8, in lower case, and blanks all else.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(x if x > 127 or chr(x).isalpha() else ord(" ") for x in bytes(range(256)).lower())
#: Documents of a language that a kept term is in, at least.
DOCUMENTS = 3
SCALE = 1_000_000_000
#: Ranks of terms.
RANKS = 200
#: Different terms that a task holds before it hands their counts on.
HELD = 1 << 19


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of every term of each group in a task, in lots of bounded size."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def lots() -> Iterator[pd.DataFrame]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 1 << 16):
                some = terms[at : at + (1 << 16)]
                yield pd.DataFrame({"lang": lang, "source": source, "term": some, "n": [n[t] for t in some], "docs": [docs[t] for t in some]})
        held.clear()

    for pdf in batches:
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"]):
            words = text.translate(_PLAIN).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from lots()
    yield from lots()


def probability(count: Column, n: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (n + terms))``, exact; by decimals where a long is too short."""
    short = F.lit(SCALE) * (count + 1)
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return 1 + F.when(count < 9_000_000_000, _div(short, n + terms)).otherwise(_div(wide, (n + terms).cast("decimal(19,0)")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def postings_of(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """``lang, term, n, sources`` of each kept term; ``sources`` has each source's count."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    counted = docs.select("lang", "source", text).mapInPandas(_counted, "lang string, source string, term binary, n long, docs long")
    # dealt once by language and term, which is all that both sums need
    counted = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    return each.where(F.col("docs") >= documents).select("lang", "term", "n", "sources")


def groups_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang, source, n, terms, lang_n, kept, zero``: each group's sums, its language's, and the probability of a term that it lacks."""
    occurring = docs.select("lang", "source").distinct()
    langs = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_n"))
    own = postings.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"), F.count(F.lit(1)).alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    all_ = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("n", "terms", "lang_n", "kept")))
    return all_.withColumn("zero", F.when(F.col("kept") > 0, probability(F.lit(0).cast("long"), F.col("n"), F.col("kept"))))


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of a language's sources.

    With ``zero`` for what a source gives a term that it lacks, the sum over all kept terms is
    that over the source's own terms against the other's ``zero``, that over the other's
    own against the source's ``zero``, the terms of neither, and for terms of both what these have wrong.
    """
    a = groups.select("lang", F.col("source").alias("a"), F.col("n").alias("a_n"), F.col("terms").alias("a_terms"), F.col("zero").alias("a_zero"), "kept")
    b = groups.select("lang", F.col("source").alias("b"), F.col("n").alias("b_n"), F.col("terms").alias("b_terms"), F.col("zero").alias("b_zero"))
    col, per_count = F.col, postings.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("a"), F.col("s.n").alias("count")).agg(F.count(F.lit(1)).alias("times"))
    p = probability(col("count"), col("a_n"), col("kept"))
    alone = per_count.join(a, ["lang", "a"]).withColumn("p", p).join(b, "lang").where("a <> b")
    alone = alone.groupBy("lang", "a", "b").agg(F.sum(col("times") * distance(col("p"), col("b_zero"))).alias("own"), F.sum(col("times") * distance(col("b_zero"), col("p"))).alias("others"))
    # terms of both: how many there are of each pair of counts, added up in the tasks that read the postings
    rest = postings.select("lang", "sources", F.posexplode("sources").alias("i", "s")).select("lang", col("s.source").alias("a"), col("s.n").alias("x"), F.explode(F.slice("sources", col("i") + 2, F.greatest(F.size("sources") - col("i") - 1, F.lit(0)))).alias("o"))
    both = rest.groupBy("lang", "a", col("o.source").alias("b"), "x", col("o.n").alias("y")).agg(F.count(F.lit(1)).alias("times")).join(a, ["lang", "a"]).join(b, ["lang", "b"])
    both = both.withColumn("p", probability(col("x"), col("a_n"), col("kept"))).withColumn("q", probability(col("y"), col("b_n"), col("kept")))
    more = lambda p, q, p0, q0: F.sum(col("times") * (distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)))
    both = both.groupBy("lang", "a", "b").agg(more(col("p"), col("q"), col("a_zero"), col("b_zero")).alias("ab"), more(col("q"), col("p"), col("b_zero"), col("a_zero")).alias("ba"))
    both = both.select("lang", F.explode(F.array(F.struct("a", "b", col("ab").alias("both")), F.struct(col("b").alias("a"), col("a").alias("b"), col("ba").alias("both")))).alias("o")).select("lang", "o.*")
    # every ordered pair is asked for: as many rows as the result has
    out = a.join(b, "lang").where("a <> b").join(alone.select("lang", "a", "b", "own"), ["lang", "a", "b"], "left")
    out = out.join(alone.select("lang", col("b").alias("a"), col("a").alias("b"), "others"), ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    zero = lambda c: F.coalesce(col(c), F.lit(0).cast("long"))
    value = zero("own") + zero("others") + zero("both") + (col("kept") - col("a_terms") - col("b_terms")) * distance(col("a_zero"), col("b_zero"))
    return out.select("lang", col("a").alias("source"), col("b").alias("item"), F.when(col("kept") > 0, value).otherwise(F.lit(0)).cast("long").alias("value"))


def _bucketed(postings: DataFrame) -> DataFrame:
    """A row for each kept term of each group, with its bucket: the group's count, and the magnitude of the language's."""
    rows = postings.select("lang", "term", F.col("n").alias("all"), F.explode("sources").alias("s"))
    return rows.select("lang", F.col("s.source").alias("source"), "term", F.col("s.n").alias("count"), "all", F.floor(F.log2("all") * 4).alias("magnitude"))


def term_values(postings: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``lang, source, item, value``: each group's terms that it uses more than its language does, the ``ranks`` farthest first.

    A bucket's bound is what its rarest frequency in the language would give. The first
    buckets by bound that hold ``ranks`` such terms for sure are evaluated; their last rank is
    what others have to reach, and buckets whose bound is strictly below it stay unread. A
    window sorts a group's buckets: its different counts times a few dozen magnitudes.
    """
    col, bucket = F.col, ["lang", "source", "count", "magnitude"]
    small = groups.select("lang", "source", "n", "lang_n", "kept")
    known = _bucketed(postings).groupBy(*bucket).agg(F.count(F.lit(1)).alias("times"), F.min("all").alias("least"), F.max("all").alias("most")).join(small, ["lang", "source"])
    known = known.withColumn("p", probability(col("count"), col("n"), col("kept")))
    q = lambda c: probability(col(c), col("lang_n"), col("kept"))
    known = known.where(col("p") > q("least")).withColumn("bound", distance(col("p"), q("least"))).withColumn("sure", F.when(col("p") > q("most"), col("times")).otherwise(0))
    best = Window.partitionBy("lang", "source").orderBy(col("bound").desc(), "count", "magnitude").rowsBetween(Window.unboundedPreceding, -1)
    known = cut(known.withColumn("before", F.coalesce(F.sum("sure").over(best), F.lit(0))).select(*bucket, "p", "lang_n", "kept", "bound", "before"), "buckets")

    order = Window.partitionBy("lang", "source").orderBy(col("value").desc(), "item")

    def evaluated(some: DataFrame) -> DataFrame:
        q = probability(col("all"), col("lang_n"), col("kept"))
        rows = _bucketed(postings).join(some.select(*bucket, "p", "lang_n", "kept"), bucket).withColumn("q", q).where("p > q")
        rows = rows.select("lang", "source", col("term").alias("item"), distance(col("p"), col("q")).alias("value"))
        return rows.withColumn("rank", F.row_number().over(order)).where(col("rank") <= ranks)

    first = cut(evaluated(known.where(col("before") < ranks)), "first")
    reached = first.where(col("rank") == ranks).select("lang", "source", col("value").alias("kth"))
    more = known.where(col("before") >= ranks).join(reached, ["lang", "source"], "left").where(col("kth").isNull() | (col("bound") >= col("kth")))
    return first.drop("rank").union(evaluated(more).drop("rank"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the parts ``pair`` (all ranks) and ``term`` (to ``ranks``).

    Null texts, languages and sources read as empty ones. A group occurs if it has a row,
    even without a term; a language without kept terms gives every pair 0. Repeated rows
    are documents of their own; ties go to the smaller item in UTF-8. A text or a
    term may have any length. An empty table gives no rows; other columns are left out.
    A result has a row for each ordered pair of a language's sources, so sources should be
    names by the thousand, not one for each document; one term's postings are one row.
    """
    name = lambda c, to: F.coalesce(F.col(c), F.lit("")).alias(to)
    docs = docs.select(name(lang, "lang"), name(source, "source"), F.col(text).alias("text"))
    postings = cut(postings_of(docs, documents), "postings")
    groups = cut(groups_of(docs, postings), "groups")
    parts = pair_values(postings, groups).withColumn("part", F.lit("pair")).unionByName(term_values(postings, groups, ranks).withColumn("part", F.lit("term")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    out = parts.withColumn("rank", F.row_number().over(order).cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return out.select("lang", "source", "part", "item", "value", "rank")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op13."""
    return audit(docs.select("lang", "source", "text"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS words FROM documents),
w AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM w GROUP BY ALL HAVING count(*) >= {DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, sum(coalesce(x.n, 0)) OVER (PARTITION BY g.lang, g.source)::BIGINT AS total, k.n AS lang_n
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, sum(n)::BIGINT AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT c.lang, source, term, c.n, 1 + (1000000000 * (c.n + 1)) // (total + v) AS p, 1 + (1000000000 * (lang_n + 1)) // (l.n + v) AS q FROM c JOIN l ON l.lang = c.lang),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f
QUALIFY part = 'pair' OR rank <= {RANKS}
"""
