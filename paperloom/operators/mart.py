"""The paper mart: a star join, priority coalescing, citation keys, funnel counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import bib_escape, key_base

# ---- fixed values: proceedings and journals as an entry names them --------------------
BOOKTITLE = {
    "CVPR": "Proceedings of the IEEE/CVF Conference on Computer Vision and Pattern Recognition",
    "ICCV": "Proceedings of the IEEE/CVF International Conference on Computer Vision",
    "ECCV": "European Conference on Computer Vision",
    "NeurIPS": "Advances in Neural Information Processing Systems",
    "ICLR": "International Conference on Learning Representations",
    "ICML": "International Conference on Machine Learning",
}
JOURNAL = {"RA-L": "IEEE Robotics and Automation Letters", "T-RO": "IEEE Transactions on Robotics", "TPAMI": "IEEE Transactions on Pattern Analysis and Machine Intelligence", "IJCV": "International Journal of Computer Vision", "TMLR": "Transactions on Machine Learning Research"}
# ------------------------------------------------------------------------------------


def star(candidates: DataFrame, **sides: DataFrame) -> DataFrame:
    """Candidates left-joined to every side by ``uid``; a side's row becomes a struct of its name."""
    out = candidates
    for name, df in sides.items():
        out = out.join(df.select("uid", F.struct(*(c for c in df.columns if c != "uid")).alias(name)), "uid", "left")
    return out


def first_of(*venues: Column) -> Column:
    """The first source that knows: override, key, registry, comment, journal, location, long tail."""
    return F.coalesce(*venues)


def cites_and_venue(papers: DataFrame, oa: DataFrame) -> DataFrame:
    """For each paper the most citations over its records, and its first known venue by position."""
    refs = papers.select("uid", F.posexplode("oa_ids").alias("pos", "oa_id")).join(oa, "oa_id")
    known = F.when(F.col("venue").isNotNull(), F.struct("pos", "venue"))
    return refs.groupBy("uid").agg(F.max("cited_by").alias("cited"), F.min(known)["venue"].alias("venue"))


def cite_keys(papers: DataFrame, order: str = "_seq") -> DataFrame:
    """Unique keys: the second paper of a base gets b, the third c, in order; after z come numbers behind a hyphen.

    A suffixed key that is another paper's base is left out, so the next suffix comes.
    """
    base = papers.withColumn("base", key_base(F.try_element_at("a", F.lit(1)), F.col("y"), F.col("t")))
    return suffixed(base, order).select(*papers.columns, "base", "nth", "key")


def suffixed(base: DataFrame, order: str = "_seq") -> DataFrame:
    """``nth`` and ``key`` of rows with a ``base``; rows are shuffled twice, so they should be few columns."""
    counts = base.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    suffix = lambda i: F.when(i <= 26, F.char(F.lit(96) + i)).otherwise(F.concat(F.lit("-"), i.cast("string")))
    # as many suffixes as there are rows, and the 25 letters more that bases may take away
    tried = counts.where("n > 1").select("base", F.explode(F.sequence(F.lit(2), (F.col("n") + 25).cast("int"))).alias("i")).withColumn("key", F.concat("base", suffix(F.col("i"))))
    free = tried.join(counts.select(F.col("base").alias("key")), "key", "left_anti")
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy("i")) + 1).select("base", "nth", F.col("key").alias("__key"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(order))
    rows = base.withColumn("nth", nth).join(free, ["base", "nth"], "left")
    return rows.withColumn("key", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.col("__key"))).drop("__key")


def disposition(prefilter: Column, labelled: Column, duplicate: Column, scope: Column) -> Column:
    """Where a candidate ends, the first reason that holds."""
    return F.when(prefilter.startswith("drop"), "prefilter_drop").when(~labelled, "unlabelled").when(duplicate, "duplicate").when(scope == "out", "excluded").otherwise(F.concat(F.lit("scope_"), scope))


def funnel(rows: DataFrame, column: str = "disposition") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def query_hits(papers: DataFrame) -> DataFrame:
    hits = papers.select("sc", F.explode("q").alias("query"))
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("sc") == "core").alias("core"))


def stats(papers: DataFrame) -> DataFrame:
    """Scalars of the whole mart in one aggregation; entries by their sources where the papers have them."""
    bs = F.col("bs") if "bs" in papers.columns else F.lit(None).cast("string")
    counts = {"n_papers": F.lit(True), "n_core": F.col("sc") == "core", "n_venue": F.col("v").isNotNull(), "n_dblp": (bs if "bs" in papers.columns else F.col("vs")) == "dblp"}
    if "bs" in papers.columns:
        counts |= {"n_bib_official": bs.isin("dblp", "crossref"), "n_bib_venue": bs.isin("dblp", "crossref", "auto-venue")}
    return papers.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def sources(papers: DataFrame) -> DataFrame:
    """``vs, n``: where the core papers' venues come from."""
    return papers.where("sc = 'core'").groupBy(F.coalesce("vs", F.lit("none")).alias("vs")).agg(F.count(F.lit(1)).alias("n"))


def bib_entry(key: Column, authors: Column, title: Column, venue: Column, kind: Column, year: Column, arxiv: Column, doi: Column) -> Column:
    """A BibTeX entry: proceedings, journal, preprint or miscellaneous, by what is known."""
    names = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
    book, journal = F.try_element_at(names(BOOKTITLE), venue), F.try_element_at(names(JOURNAL), venue)
    who = F.when(F.size(authors) > 0, F.array_join(authors, " and ")).otherwise("Anonymous")
    head = F.concat(key, F.lit(",\n  title = {"), bib_escape(title), F.lit("},\n  author = {"), who, F.lit("},\n"))
    tail = F.concat(F.lit("  year = {"), year.cast("string"), F.lit("}\n}"))
    field = lambda n, v: F.concat(F.lit(f"  {n} = {{"), v, F.lit("},\n"))
    return (
        F.when(book.isNotNull() & (F.coalesce(kind, F.lit("main")) != "workshop"), F.concat(F.lit("@inproceedings{"), head, field("booktitle", book), tail))
        .when(journal.isNotNull(), F.concat(F.lit("@article{"), head, field("journal", journal), tail))
        .when(arxiv.isNotNull(), F.concat(F.lit("@article{"), head, field("journal", F.concat(F.lit("arXiv preprint arXiv:"), arxiv)), tail))
        .otherwise(F.concat(F.lit("@misc{"), head, F.coalesce(field("doi", doi), F.lit("")), tail))
    )


# ---- fixed values: lengths that the wide table keeps --------------------------------------
AUTHORS, GIST, SUMMARY = 30, 700, 400
# --------------------------------------------------------------------------------------------


def project(rows: DataFrame) -> DataFrame:
    """The wide table of papers from the star's rows: short names, bounded authors, gist and summary of a note.

    ``rows`` has the candidate's columns and the structs ``label, venue, note`` and
    ``registry`` of ``star``, whose fields may be missing; the first DOI known wins, and the companies of a label
    stand before those detected.
    """
    none, text = F.array().cast("array<string>"), lambda c: F.coalesce(c, F.lit(""))
    note, label, venue, registry = F.col("note"), F.col("label"), F.col("venue"), F.col("registry")

    def of(side: str, name: str, kind: str = "string") -> Column:
        """A field of a side, null where the side has none of that name."""
        return F.col(side)[name] if name in rows.schema[side].dataType.names else F.lit(None).cast(kind)

    many = lambda name: F.coalesce(of("label", name, "array<string>"), none)
    own = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    wide = rows.select(
        F.col("uid").alias("id"), F.col("arxiv_id").alias("ax"), F.col("title").alias("t"), label["name"].alias("n"), F.slice(F.coalesce("authors", none), 1, AUTHORS).alias("a"),
        F.col("year").alias("y"), F.col("date").alias("d"), text(F.col("abstract")).alias("ab"), text(label["tldr"]).alias("tl"), label["scope"].alias("sc"), F.coalesce(label["tasks"], none).alias("tk"),
        many("settings").alias("st"), F.coalesce(label["paradigm"], F.lit("none")).alias("pd"), many("contrib").alias("ct"), many("traits").alias("tr"), F.coalesce(label["benchmarks"], none).alias("bm"), F.coalesce(of("label", "conf"), F.lit("high")).alias("cf"),
        venue["label"].alias("v"), venue["venue"].alias("vn"), venue["kind"].alias("vk"), of("venue", "source").alias("vs"),
        F.coalesce("cited", F.lit(0)).alias("c"), F.coalesce(label["co"], F.col("companies"), none).alias("co"), F.coalesce(registry["doi"], F.col("doi_pub"), F.col("doi")).alias("doi"),
        F.coalesce(own("sources", "array<string>"), none).alias("src"), F.coalesce(own("queries", "array<string>"), none).alias("q"), own("comment", "string").alias("cm"), F.substring(own("first_seen", "string"), 1, 10).alias("fs"),
        F.when(note.isNotNull(), 1).alias("r"), F.when(note.isNotNull(), F.substring(F.concat_ws(" ", text(note["key_idea"]), text(note["insight"])), 1, GIST)).alias("rk"), F.substring(note["summary"], 1, SUMMARY).alias("sm"),
        of("registry", "dblp").alias("__dblp"), of("registry", "bibtex").alias("__registry"),
    )
    return wide.withColumn("bs", bib_source(F.col("__dblp"), F.col("__registry"), F.col("vn"), F.col("vk"), F.col("ax"))).drop("__dblp", "__registry")


def bib_source(dblp: Column, registry: Column, venue: Column, kind: Column, arxiv: Column) -> Column:
    """Where a paper's entry comes from: an official one, one made from its venue, its preprint, or what is left."""
    made = venue.isin(*BOOKTITLE, *JOURNAL) & (F.coalesce(kind, F.lit("main")) != "workshop")
    return F.when(dblp.isNotNull(), "dblp").when(registry.isNotNull(), "crossref").when(F.coalesce(made, F.lit(False)), "auto-venue").when(arxiv.isNotNull(), "arxiv").otherwise("misc")
