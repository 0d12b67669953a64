"""Entity resolution: folding records of two sources, prefilter, fuzzy duplicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import norm_title, spaced_title, surname, surnames
from paperloom.operators.similarity import alike
from paperloom.sources.staging import cut

# ---- fixed values ------------------------------------------------------------------
BAD_TYPES = "dataset paratext peer-review erratum editorial retraction supplementary-materials libguides other letter grant".split()
# ------------------------------------------------------------------------------------


def known_title(title: Column) -> Column:
    """The normalised title, an empty one included."""
    return norm_title(F.coalesce(title, F.lit("")))


def _nothing(key: str) -> Column:
    """An empty text where there is a key, as a second key of a join; no literal, as the planner would take that out of the join."""
    return F.substring(F.col(key).cast("string"), 1, 0)


def fold(harvested: DataFrame, other: DataFrame, identity: Callable[[Column], Column] = known_title) -> DataFrame:
    """Records of ``other`` folded, in their order, into ``harvested`` and into each other; ``oa_id, uid``.

    Both have ``arxiv_id, title, _seq``, ``other`` also ``oa_id``. A record belongs to the row
    of its arXiv id, else to that of its normalised title, an empty one included; of harvested rows with one
    title the last has it. A record that finds neither is a row of its own, under its arXiv
    id or ``oa:`` and its own, and from then on has both its id and its title; so what a
    record finds depends on those before it. Joins are by equality, so no pair of titles is compared.
    Another ``identity`` may give letters and digits of its own, or null for a title that is none and equals no other.
    """
    title = identity(F.col("title"))
    by_title = harvested.select(F.col("arxiv_id").alias("title_uid"), title.alias("nt"), "_seq").where("nt is not null").groupBy("nt").agg(F.max_by("title_uid", "_seq").alias("title_uid"))
    by_id = harvested.select(F.col("arxiv_id").alias("key"), _nothing("arxiv_id").alias("__own"), F.col("arxiv_id").alias("id_uid")).distinct()
    key = F.when(F.col("arxiv_id") != "", F.col("arxiv_id"))
    rows = other.select("oa_id", key.alias("key"), title.alias("nt"), F.struct("_seq", "oa_id").alias("at")).withColumn("own", F.coalesce("key", F.concat(F.lit("oa:"), "oa_id")))
    rows = rows.withColumn("nt", F.coalesce("nt", F.concat(F.lit(":"), "own")))  # no title is like that
    # records without an id are dealt by their own, as one key they would be one task's
    rows = rows.withColumn("__own", F.coalesce(_nothing("key"), F.col("oa_id").cast("string")))
    rows = cut(rows.join(by_id, ["key", "__own"], "left").drop("__own").join(by_title, "nt", "left"), "records")
    new = _first_of_links(rows.where("id_uid is null and title_uid is null").select("at", "own", "nt"))
    by_own = new.select("own", F.col("own").alias("own_uid"), F.col("at").alias("own_at"))
    by_new_title = new.select("nt", F.col("own").alias("nt_uid"), F.col("at").alias("nt_at"))
    rows = rows.join(by_own, "own", "left").join(by_new_title, "nt", "left")
    mine, theirs = F.when(F.col("own_at") <= F.col("at"), F.col("own_uid")), F.when(F.col("nt_at") <= F.col("at"), F.col("nt_uid"))
    return rows.select("oa_id", F.coalesce("id_uid", F.when(F.col("key").isNotNull(), mine), "title_uid", theirs, mine).alias("uid"))


#: So many records that are still open are settled by one task.
_FEW = 4096


def _first_of_links(rows: DataFrame) -> DataFrame:
    """Rows (at, own, nt) that share neither ``own`` nor ``nt`` with an earlier row that stays.

    A row that is the first of both its id and its title stays, and what shares one with it
    goes. Each round settles those for all rows at once; what later rows wait for gets shorter with it.
    """
    left, stay = cut(rows, "open"), []
    while (n := left.count()) > 0:
        if n <= _FEW:
            flat = left.select("at._seq", "at.oa_id", "own", "nt").coalesce(1).sortWithinPartitions("_seq", "oa_id")
            stay.append(flat.mapInPandas(_settled, flat.schema).select(F.struct("_seq", "oa_id").alias("at"), "own", "nt"))
            break
        first = lambda c: left.groupBy(c).agg(F.min("at").alias(f"{c}_at"))  # noqa: E731, B023
        found = cut(left.join(first("own"), "own").join(first("nt"), "nt").where("at = own_at and at = nt_at").select("at", "own", "nt"), "first")
        stay.append(found)
        left = cut(left.join(found.select("own"), "own", "left_anti").join(found.select("nt"), "nt", "left_anti").select("at", "own", "nt"), "open")
    return cut(reduce(DataFrame.union, stay), "rows") if stay else left


def _settled(batches):
    ids, titles = set(), set()
    for pdf in batches:
        keep = []
        for own, nt in zip(pdf["own"], pdf["nt"]):
            keep.append(own not in ids and nt not in titles)
            if keep[-1]:
                ids.add(own)
                titles.add(nt)
        yield pdf[keep]


def first_of_title(rows: DataFrame, title: str = "title", order: str = "_seq") -> DataFrame:
    """One row of each normalised title, the first; rows without a title all stay."""
    nt = norm_title(F.col(title))
    nth = F.row_number().over(Window.partitionBy("__nt", F.when(F.col("__nt") == "", F.col(order))).orderBy(order))
    return rows.withColumn("__nt", nt).withColumn("__nth", nth).where("__nth = 1").drop("__nt", "__nth")


def prefilter(relevant: Column, strict: Column, good_category: Column, min_year: int = 2016) -> Column:
    """Why a candidate is dropped, in strict order; ``keep`` if nothing says so. Seeds always stay."""
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    oa_only = F.col("arxiv_id").isNull()
    filed = F.size(F.coalesce("categories", F.array().cast("array<string>"))) > 0
    return (
        F.when(F.array_contains("queries", "seed"), "keep")
        .when(title == "", "drop:no-title")
        .when(~relevant, "drop:no-term")
        .when(F.coalesce(F.col("oa_type").isin(BAD_TYPES), F.lit(False)) | title.rlike(r"(?i)^(dataset|supplementary|data) (from|for) "), "drop:type")
        .when(oa_only & ~strict, "drop:oa-weak")
        .when(filed & ~good_category, "drop:category")
        .when(oa_only & (abstract == "") & (F.col("year") > 0) & (F.col("year") < 2015), "drop:old-no-abstract")
        .when((F.col("year") > 0) & (F.col("year") < min_year), f"drop:pre-{min_year}")
        .otherwise("keep")
    )


def harvested_rows(harvested: DataFrame) -> DataFrame:
    """Harvested records as candidates: day and year of the publication text, one source, no records of the other kind."""
    day = F.substring("published", 1, 10)
    return harvested.select(
        F.col("id").alias("uid"), F.col("id").alias("arxiv_id"), "title", "abstract", "authors", day.alias("date"), F.coalesce(F.substring("published", 1, 4).try_cast("int"), F.lit(0)).alias("year"),
        "categories", "comment", "journal_ref", "doi", F.array(F.lit("arxiv")).alias("sources"), "first_seen", "queries", F.array().cast("array<string>").alias("oa_ids"), F.lit(None).cast("string").alias("oa_type"), "_seq",
    )


#: Widths of the year blocks that candidate pairs meet in.
_YEARS = 3


def _surname_keys(names: Column, first: Column) -> Column:
    """The first surname, and every two surnames in order: rows that share a key meet the author rule."""
    one = F.when(first.isNotNull(), F.array(F.concat(F.lit("1 "), first))).otherwise(F.array().cast("array<string>"))
    some = F.array_sort(F.array_distinct(names))
    two = F.flatten(F.transform(some, lambda x: F.transform(F.filter(some, lambda y: y > x), lambda y: F.concat_ws(" ", F.lit("2"), x, y))))
    return F.concat(one, two)


def shared_surnames(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


#: All but lower-case letters, digits and spaces; spelled out it is found several times faster than by what it is not.
_SIGNS = r"[\x00-\x1f!-/:-`{-\x{10FFFF}]+"


def fuzzy_duplicates(rows: DataFrame, ratio: float = 0.9, years: int = 2) -> DataFrame:
    """``dup, keeper``: rows without an arXiv id that repeat one with it.

    ``rows`` has ``uid, arxiv_id, linked, name, title, year, authors, _seq`` with folded
    author names. A row whose ``linked`` id is a keeper's repeats that one. Else keepers
    of the same name (three letters or more) are looked at, or, if there is none, those
    with a title more than ``ratio`` alike; years are ``years`` apart at most (an unknown
    one is 0), and two surnames are common, or the first author's is. The first keeper in
    order wins. Rows without authors share no first author.

    Rows meet in equi-joins on the first surname, or any two. For titles, different ones of
    a surname and a block of years meet by their rare grams (``similarity``), however common
    the surname; copies of a title are one, and rows join in for what is alike only.
    """
    last = surnames(F.col("authors"))
    first = F.when(F.size("authors") > 0, surname(F.element_at("authors", 1)))
    title = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), _SIGNS, "")
    r = rows.select("uid", "arxiv_id", "linked", "_seq", F.when(F.length(F.trim("name")) >= 3, F.lower(F.trim("name"))).alias("nm"), title.alias("nt"), F.coalesce("year", F.lit(0)).alias("y"), last.alias("last"), first.alias("first"))
    r = cut(r, "names")  # surnames are folded once, however often rows are read
    keep, other = r.where("arxiv_id is not null"), r.where("arxiv_id is null")
    linked = other.select("uid", F.col("linked").alias("arxiv_id")).join(keep.groupBy("arxiv_id").agg(F.max_by("uid", "_seq").alias("keeper")), "arxiv_id").select(F.col("uid").alias("dup"), "keeper")
    other = other.join(linked.select(F.col("dup").alias("uid")), "uid", "left_anti")
    # rows without a name are dealt by their uid
    names = keep.where("nm is not null").select("nm", _nothing("nm").alias("__own")).distinct().withColumn("namesake", F.lit(True))
    other = other.withColumn("__own", F.coalesce(_nothing("nm"), F.col("uid").cast("string")))
    other = other.join(names, ["nm", "__own"], "left").drop("__own")
    keyed = lambda df: df.withColumn("s", F.explode(_surname_keys(F.col("last"), F.col("first"))))
    block = F.floor(F.col("y") / _YEARS)
    wide = lambda df: df.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))

    def firsts(on: str) -> DataFrame:
        """The first keeper of each surname key, year and name or title."""
        return keyed(keep.where(F.col(on).isNotNull())).groupBy("s", "y", on).agg(F.min(F.struct("_seq", "uid")).alias("first_"))

    def nearest_first(asked: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
        """For every asked row the first keeper of one of its keys with a year near enough."""
        near = asked.withColumn("block", block).join(wide(kept).withColumnRenamed("y", "a_y"), [*on, "block"]).where(F.abs(F.col("y") - F.col("a_y")) <= years)
        return near.groupBy("uid").agg(F.min("first_").alias("first_"))

    named = nearest_first(keyed(other.where("namesake")).select("uid", "s", "nm", "y"), firsts("nm"), ["s", "nm"])
    asked = keyed(other.where("namesake is null")).select("uid", "s", F.col("nt").alias("b_nt"), "y")
    kept = firsts("nt").withColumnRenamed("nt", "a_nt")
    texts = lambda df, c: df.select("s", "block", F.col(c).alias("id"), F.col(c).alias("text"))
    pairs = alike(texts(kept.withColumn("block", block), "a_nt"), texts(wide(asked), "b_nt"), ratio, ("s", "block"), strictly=True)
    # empty titles are as alike as can be
    pairs = pairs.select(F.col("a").alias("a_nt"), F.col("b").alias("b_nt")).union(rows.sparkSession.createDataFrame([("", "")], "a_nt string, b_nt string"))
    by_pair = kept.join(pairs, "a_nt").groupBy("s", "y", "b_nt").agg(F.min("first_").alias("first_"))
    found = named.union(nearest_first(asked, by_pair, ["s", "b_nt"]))
    return found.select(F.col("uid").alias("dup"), F.col("first_.uid").alias("keeper")).union(linked)


def twin_by_title(papers: DataFrame, index: DataFrame, least: float = 0.92) -> DataFrame:
    """``uid, found, exact``: the entry of an index (title, found) with a paper's title, else the most alike one.

    Exact titles meet by equality; of equal entries the smallest ``found`` counts. For the
    rest different titles meet by their rare grams, so none that is at least ``least`` alike is lost;
    the greatest ratio wins, then the greater title. Papers and entries without a letter or
    digit in the title have no twin.
    """
    key = lambda c: spaced_title(F.col(c))
    p = papers.select("uid", key("title").alias("want")).where("want <> ''")
    i = index.select(key("title").alias("got"), "found").where("got <> ''").groupBy("got").agg(F.min("found").alias("found"))
    exact = p.join(i, p.want == i.got).select("uid", "found", F.lit(True).alias("exact"))
    rest = p.join(i.select(F.col("got").alias("want")), "want", "left_anti")
    text = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("text")).distinct()
    near = alike(text(rest, "want"), text(i, "got"), least).select(F.col("a").alias("want"), F.col("b").alias("got"), "ratio").join(i, "got")
    best = near.groupBy("want").agg(F.max_by("found", F.struct("ratio", "got")).alias("found"))
    return exact.unionByName(rest.join(best, "want").select("uid", "found", F.lit(False).alias("exact")))


def priority_lookup(rows: DataFrame, index: DataFrame, keys: list[Column]) -> DataFrame:
    """First hit of several keys in order; ``index`` is (key, uid). Left joins, no OR."""
    out = rows
    for i, k in enumerate(keys):
        out = out.join(index.select(F.col("key").alias(f"__k{i}"), F.col("uid").alias(f"__u{i}")), k == F.col(f"__k{i}"), "left")
    found = F.coalesce(*(F.col(f"__u{i}") for i in range(len(keys))))
    return out.withColumn("found", found).drop(*(f"__{x}{i}" for i in range(len(keys)) for x in "ku"))
