"""A library built from its raw tables: fold, prefilter, labels, duplicates, star, board, published tables.

Each stage runs once. What several stages read is written between them, so the fold
or the duplicates are not planned anew for every table that comes of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import key_base
from paperloom.operators import log, mart, publish, resolve
from paperloom.sources.staging import cut


@dataclass
class Raw:
    """What a library is made of. Only the first three have to be there; ``uid`` keys all sides.

    ``harvested``: id, title, abstract, authors, published, categories, comment, journal_ref, doi,
    first_seen, queries, _seq. ``other``: oa_id, arxiv_id, title, abstract, authors, date, year,
    type, doi, queries, cited_by, _seq. ``labels``: a log with _seq. ``overrides``: uid, set (a map). ``linked``:
    uid and the arXiv id that a registry knows for it. ``notes``: uid, key_idea, insight, summary, numbers.
    """

    harvested: DataFrame
    other: DataFrame
    labels: DataFrame
    overrides: DataFrame | None = None
    linked: DataFrame | None = None
    venues: DataFrame | None = None
    registry: DataFrame | None = None
    notes: DataFrame | None = None
    sides: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Rules:
    """What a domain says of a candidate."""

    relevant: Callable[[Column], Column]
    strict: Callable[[Column], Column]
    filed: Callable[[Column], Column]
    min_year: int = 2010


_NONE = "array<string>"


def candidates(harvested: DataFrame, other: DataFrame) -> DataFrame:
    """Harvested records and those of the other source that fold into none, each with all that folded into it.

    A new row has its first record's fields. Its id or title is nobody else's, as the fold
    would have found it, so no second pass over titles is needed.
    """
    folded = cut(resolve.fold(harvested.select(F.col("id").alias("arxiv_id"), "title", "_seq"), other.select("oa_id", "arxiv_id", "title", "_seq")), "folded")
    rows = other.join(folded, "oa_id")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_seq", c))), lambda x: x[c])
    joined = rows.groupBy("uid").agg(
        in_order("oa_id").alias("oa"), F.array_distinct(F.flatten(in_order("queries"))).alias("asked"), F.max("cited_by").alias("cited"),
        F.min_by(F.struct("arxiv_id", "title", "abstract", "authors", "date", "year", "doi", "type", "_seq"), "_seq").alias("first"),
    )
    mine = resolve.harvested_rows(harvested).join(joined, "uid", "left")
    some = lambda c: F.coalesce(c, F.array().cast(_NONE))
    asked = F.transform(some(F.col("asked")), lambda q: F.concat(F.lit("oa:"), q))
    known = mine.withColumns({"oa_ids": some(F.col("oa")), "queries": F.array_union(some(F.col("queries")), asked), "sources": F.when(F.col("oa").isNotNull(), F.array(F.lit("arxiv"), F.lit("openalex"))).otherwise(F.col("sources"))}).drop("oa", "asked", "first")
    f, text = F.col("first"), lambda c: F.coalesce(c, F.lit(""))
    new = joined.join(harvested.select(F.col("id").alias("uid")), "uid", "left_anti").select(
        "uid", F.when(f["arxiv_id"] != "", f["arxiv_id"]).alias("arxiv_id"), f["title"].alias("title"), text(f["abstract"]).alias("abstract"), some(f["authors"]).alias("authors"), text(f["date"]).alias("date"), F.coalesce(f["year"], F.lit(0)).alias("year"),
        F.array().cast(_NONE).alias("categories"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("string").alias("journal_ref"), f["doi"].alias("doi"), F.array(F.lit("openalex")).alias("sources"), F.lit(None).cast("string").alias("first_seen"),
        asked.alias("queries"), F.col("oa").alias("oa_ids"), f["type"].alias("oa_type"), f["_seq"].alias("_seq"), "cited",
    )
    return known.unionByName(new)


def staged(raw: Raw, rules: Rules) -> dict[str, DataFrame]:
    """``candidates`` with where each of them ends, ``papers``, ``excluded``, ``board`` and ``funnel``."""
    found = candidates(raw.harvested, raw.other)
    text = F.concat_ws(" ", "title", "abstract")
    found = found.withColumn("prefilter", resolve.prefilter(rules.relevant(text), rules.strict(text), rules.filed(F.col("categories")), rules.min_year))
    label = log.last_write(raw.labels, "uid")
    label = label.drop("_seq")
    if raw.overrides is not None:
        label = label.join(raw.overrides.select("uid"), "uid", "full")  # a paper may have an override alone
        label = log.override(label, raw.overrides, "uid", [c for c in label.columns if c != "uid" and not dict(label.dtypes)[c].startswith(("array", "struct", "map"))])
    found = cut(mart.star(found, label=label), "candidates")
    open_ = found.where((F.col("prefilter") == "keep") & F.col("label").isNotNull() & (F.col("label")["scope"] != "out"))
    linked = raw.linked if raw.linked is not None else open_.select("uid", F.lit(None).cast("string").alias("linked")).limit(0)
    # harvested rows come first in the order of keepers, the others behind them
    twins = open_.join(linked, "uid", "left").select("uid", "arxiv_id", "linked", F.col("label")["name"].alias("name"), "title", "year", "authors", F.struct(F.col("arxiv_id").isNull(), "_seq").alias("_seq"))
    dups = cut(resolve.fuzzy_duplicates(twins).select(F.col("dup").alias("uid"), "keeper"), "duplicates")
    ends = mart.disposition(F.col("prefilter"), F.col("label").isNotNull(), F.col("keeper").isNotNull(), F.col("label")["scope"])
    placed = cut(found.join(dups, "uid", "left").withColumn("disposition", ends), "placed")
    why = F.when(F.col("disposition") == "prefilter_drop", F.col("prefilter")).when(F.col("disposition") == "duplicate", F.concat(F.lit("dup-of:"), "keeper")).otherwise("llm:out")
    excluded = placed.where(F.col("disposition").isin("prefilter_drop", "duplicate", "excluded")).select(F.col("uid").alias("id"), F.col("title").alias("t"), F.col("year").alias("y"), why.alias("why"))
    # a keeper has its duplicates' records and, if it lacks one, a published DOI of theirs
    theirs = placed.where("keeper is not null").groupBy(F.col("keeper").alias("uid")).agg(F.flatten(F.collect_list("oa_ids")).alias("more_ids"), F.min("doi").alias("doi_pub"))
    stays = F.startswith("disposition", F.lit("scope_"))
    kept = placed.where(stays).join(theirs, "uid", "left")
    kept = kept.withColumn("oa_ids", F.array_union("oa_ids", F.coalesce("more_ids", F.array().cast(dict(kept.dtypes)["oa_ids"])))).drop("more_ids")
    sides = {"venue": raw.venues, "registry": raw.registry, "note": raw.notes}
    empty = {"venue": "uid string, venue string, label string, kind string, source string", "registry": "uid string, doi string, dblp string, bibtex string", "note": "uid string, key_idea string, insight string, summary string, numbers array<struct<bench:string,metrics:map<string,string>>>"}
    spark = found.sparkSession
    wide = mart.star(kept, **{k: v if v is not None else spark.createDataFrame([], empty[k]) for k, v in sides.items()} | raw.sides)
    # keys are made of a few columns, so titles and abstracts are not shuffled for them
    base = key_base(F.try_element_at("authors", F.lit(1)), F.col("year"), F.col("title"))
    bases = cut(placed.where(stays).select(F.col("uid").alias("id"), base.alias("base"), F.struct(F.col("arxiv_id").isNull(), "_seq").alias("_seq")), "bases")
    papers = mart.project(wide.withColumn("companies", F.array().cast(_NONE))).join(mart.suffixed(bases).select("id", "key"), "id")
    papers = cut(papers, "papers")
    n = F.col("note")["numbers"]
    results = wide.select(F.col("uid").alias("id"), F.explode(n).alias("row")).where(F.size(F.coalesce("row.metrics", F.create_map().cast("map<string,string>"))) > 0)
    board = results.join(papers.select("id", "n", "t", "y", "v", "pd", "sc", "co"), "id").select("id", "n", "t", "y", "v", "pd", "sc", "co", F.regexp_replace("row.bench", r"^other:\s*", "").alias("bench"), F.col("row.metrics").alias("m"), *([F.col("row.verified").alias("ok")] if "verified" in _fields(raw.notes) else [F.lit(None).cast("boolean").alias("ok")]))
    return {"candidates": placed, "papers": papers, "excluded": excluded, "board": cut(board, "board"), "funnel": mart.funnel(placed)}


def _fields(notes: DataFrame | None) -> list[str]:
    return [] if notes is None else notes.schema["numbers"].dataType.elementType.names


def library(raw: Raw, rules: Rules, paradigms: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The stages, published as one version of a site in ``folder``; what was written is returned besides."""
    made = staged(raw, rules)
    site = publish.build(made["papers"], made["board"], made["excluded"], paradigms) | {"funnel": made["funnel"], "sources": mart.sources(made["papers"]), "queries": mart.query_hits(made["papers"])}
    publish.write(site, folder, notes=raw.notes)
    return made | site
