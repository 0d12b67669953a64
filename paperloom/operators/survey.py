"""The data of a survey: main and appendix tables, figures, and the references that its text cites."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import LOWER_BETTER, PERCENT, clean_bib
from paperloom.operators import board as rules
from paperloom.operators import lineage, trends
from paperloom.sources.staging import cut

# ---- fixed values: rows of a main table, of the others, and when a record gets a label -------
RECORDS, RECORDS_OTHER, PER_GROUP, PER_GROUP_OTHER, OTHERS = 2, 1, 4, 2, 8
GAP_ONE_ROW, GAP, RISE = 1.6, 0.8, 12
CITED = r"\\cite[pt]?\*?(?:\[[^\]]*\])*\{([^}]+)\}"
# ------------------------------------------------------------------------------------------------


def best_of_papers(rows: DataFrame, metric: str, shared: bool = True) -> DataFrame:
    """Each paper's best row of each bench and split: ``cls`` 0 comparable, 1 on a subset that papers share.

    Usable rows with the metric; a percent metric of 1 or less is a fraction by mistake and
    left out. Comparable rows stand before others, main methods before ablations.
    """
    judged = rules.comparable(rows).where(rules.usable(F.col("ok"), F.col("audit_ok"), F.col("m")))
    value = F.try_element_at("m", F.lit(metric)).try_cast("double")
    judged = judged.withColumn("value", value).where("value is not null")
    if metric in PERCENT:
        judged = judged.where("value > 1")
    note = F.lower(F.coalesce("audit_note", F.lit("")))
    on_subset = F.col("protocol").isNotNull() & ~(F.coalesce(F.col("audit_std") == F.lit(False), F.lit(False)) & ~F.contains(note, F.lit("subset")))
    judged = judged.withColumn("cls", F.when(F.col("comparable"), 0).when(on_subset & F.lit(shared), 1)).where("cls is not null")
    sign = -1 if metric in LOWER_BETTER else 1
    order = [F.col("cls"), rules.is_ablation(F.col("method")).cast("int"), (F.col("value") * sign).desc(), F.col("_seq")]
    nth = F.row_number().over(Window.partitionBy("bench", "split", "id").orderBy(*order))
    return judged.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def main_table(best: DataFrame, notable: Column, metric: str, per_group: int = PER_GROUP, per_group_other: int = PER_GROUP_OTHER) -> DataFrame:
    """What a table in the body shows of each bench and split: notable papers' best of each paradigm, with bold and underlined places."""
    sign = -1 if metric in LOWER_BETTER else 1
    seen = best.where(notable).withColumn("rank", F.row_number().over(Window.partitionBy("bench", "split", "pd", "cls").orderBy((F.col("value") * sign).desc(), "_seq")))
    kept = seen.where(F.col("rank") <= F.when(F.col("cls") == 0, per_group).otherwise(per_group_other))
    place = F.dense_rank().over(Window.partitionBy("bench", "split", "cls").orderBy((F.col("value") * sign).desc()))
    return kept.withColumn("place", F.when((F.col("cls") == 0) & (place <= 2), place))


def appendix_table(best: DataFrame, worthy: Column, cited: Column, metric: str, top: int) -> DataFrame:
    """The complete rankings: ``block`` comparable (by paradigm), shared (by protocol) and other; what the text cites is always in."""
    sign = -1 if metric in LOWER_BETTER else 1
    block = F.when(F.col("cls") == 0, "comparable").when(F.col("cls") == 1, "shared").otherwise("other")
    rows = best.where(worthy).withColumn("block", block).withColumn("group", F.when(F.col("cls") == 0, F.col("pd")).when(F.col("cls") == 1, F.col("protocol")))
    rank = F.row_number().over(Window.partitionBy("bench", "split", "block", "group").orderBy((F.col("value") * sign).desc(), "_seq"))
    most = F.when(F.col("block") == "comparable", top).when(F.col("block") == "other", OTHERS).otherwise(2**31 - 1)
    return rows.withColumn("rank", rank).where((F.col("rank") <= most) | F.coalesce(cited, F.lit(False)))


def progress(points: DataFrame, group: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """Points that are records, with the record before: the step line of a figure."""
    return rules.records(points, group, [F.col(at), F.col(value).desc(), F.col("id")], value)


def labelled(records: DataFrame, group: list[str], at: str = "at", value: str = "value", name: str = "n", gap: float = GAP, rise: float = RISE) -> DataFrame:
    """Records with a name that get a label: not the first, and far enough in time or value from the last labelled one.

    The choice runs along a figure's records, which are few; a fold over their array keeps
    it in the row of the figure.
    """
    r = F.struct(F.col(at).alias("at"), F.col(value).alias("value"), F.col(name).alias("name"), F.col("id"))
    rows = records.groupBy(*group).agg(F.sort_array(F.collect_list(r)).alias("r"))
    kind = dict(rows.dtypes)["r"]
    none = F.array().cast(kind)

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        far = (F.size(kept) == 0) | (x["at"] - last["at"] > gap) | (x["value"] - last["value"] > rise)
        return F.when(F.coalesce(x["name"], F.lit("")).eqNullSafe(F.lit("")) | ~far, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.slice(F.col("r"), F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), none, step)
    return rows.select(*group, F.explode(kept).alias("x")).select(*group, "x.id", "x.at", "x.value", F.when(F.length("x.name") <= 20, F.col("x.name")).otherwise(F.concat(F.regexp_replace(F.substring("x.name", 1, 19), r"\s+\S*$", ""), F.lit("…"))).alias("label"))


def benches_shown(tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Benchmarks that a table or a figure shows."""
    return tables.select("bench").union(figures.select("bench")).distinct()


def cited_keys(texts: DataFrame, text: str = "text") -> DataFrame:
    """All keys that the sections cite."""
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITED), 1), lambda k: F.transform(F.split(k, ","), lambda x: F.trim(x))))
    return texts.select(F.explode(found).alias("key")).where("key <> ''").distinct()


def references(entries: DataFrame, by_hand: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries (key, bib) that a text cites, those kept by hand before generated ones of the same key, cleaned; and the keys without one."""
    own = entries.join(by_hand.select("key"), "key", "left_anti").unionByName(by_hand.select("key", "bib"))
    got = own.join(cited, "key", "left_semi").dropDuplicates(["key"]).withColumn("bib", clean_bib(F.col("bib")))
    return got, cited.join(own.select("key"), "key", "left_anti")


# ---- a survey from its declaration ---------------------------------------------------------------


@dataclass(frozen=True)
class Board:
    """One leaderboard of a survey: a benchmark's split, the metric it is ranked by, the metrics it shows."""

    bench: str
    split: str
    metric: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class BodyTable:
    """A table in the body: boards side by side, and the papers (by name or key) that are always in it."""

    name: str
    boards: tuple[Board, ...]
    anchors: tuple[str, ...] = ()
    records: int = RECORDS
    per_group: int = PER_GROUP
    per_group_other: int = PER_GROUP_OTHER
    cites: int | None = None


@dataclass(frozen=True)
class Spec:
    """What a survey declares; see ``compiled``."""

    scope: dict[str, tuple[str, ...]]
    context: dict | None = None
    tables: tuple[Board, ...] = ()
    main_tables: tuple[BodyTable, ...] = ()
    figures: tuple[Board, ...] = ()
    top: int = 10


def in_scope(papers: DataFrame, scope: dict[str, tuple[str, ...]]) -> Column:
    """True for a paper that has one of the values of every field that the scope names."""
    kinds, out = dict(papers.dtypes), F.lit(True)
    for c, values in scope.items():
        if values:
            wanted = F.array(*map(F.lit, values))
            out &= F.coalesce(F.arrays_overlap(F.col(c), wanted) if kinds[c].startswith("array") else F.col(c).isin(*values), F.lit(False))
    return out


def compiled(spec: Spec, papers: DataFrame, readings: DataFrame, board: DataFrame, cited: DataFrame | None = None, landmarks: DataFrame | None = None) -> dict[str, DataFrame]:
    """The data of a survey, by the parts that its declaration asks for.

    ``scope`` and ``context`` are ids; ``tables`` the complete rankings of its boards, with all
    that the text (``cited``: id) cites; ``main`` the rows of the body's tables; ``figures`` the
    records of each board over time. The board is read once for each metric, and only rows of boards
    that the declaration names; best rows are written, as all parts start from them.
    """
    spark, scope = papers.sparkSession, papers.where(in_scope(papers, spec.scope))
    out = {"scope": scope.select("id")}
    if spec.context is not None:
        numbers = {k: v for k, v in spec.context.items() if k in ("mentions", "cites")}
        ids = spark.createDataFrame([(x,) for x in spec.context.get("ids", ())], f"id {dict(papers.dtypes)['id']}")
        out["context"] = lineage.context_of(readings, papers, scope, landmarks=landmarks if spec.context.get("landmarks", True) else None, ids=ids, **numbers)
    every = [*spec.tables, *spec.figures, *(b for t in spec.main_tables for b in t.boards)]
    best = {}
    for metric in dict.fromkeys(b.metric for b in every):
        wanted = spark.createDataFrame(sorted({(b.bench, b.split) for b in every if b.metric == metric}), "bench string, split string")
        best[metric] = cut(best_of_papers(board.join(F.broadcast(wanted), ["bench", "split"], "left_semi"), metric), "best_rows")  # a declaration's boards
    of = lambda b: best[b.metric].where((F.col("bench") == b.bench) & (F.col("split") == b.split))
    cells = lambda b: F.map_filter("m", lambda k, _: k.isin(*(b.columns or (b.metric,)))).alias("cells")
    if spec.tables:
        always = (cited if cited is not None else papers.select("id").limit(0)).select("id").distinct().withColumn("__cited", F.lit(True))
        parts = []
        for b in spec.tables:
            ranked = appendix_table(of(b).join(always, "id", "left"), F.lit(True), F.col("__cited"), b.metric, spec.top)
            parts.append(ranked.select("bench", "split", "block", "group", "rank", "id", "value", cells(b)))
        out["tables"] = reduce(DataFrame.unionByName, parts)
    if spec.main_tables:
        out["main"] = reduce(DataFrame.unionByName, [_body(t, of, papers, cells) for t in spec.main_tables])
    if spec.figures:
        parts = []
        for b in spec.figures:
            when = papers.select("id", F.round(trends.fractional_year(F.col("d"), F.col("y"), half=True), 6).alias("at"))
            sign = -1 if b.metric in LOWER_BETTER else 1
            shown = of(b).where((F.col("cls") == 0) & (F.col("value") > 1) & ~rules.is_ablation(F.col("method"), strict=True))
            shown = shown.select("bench", "split", "id", (F.col("value") * sign).alias("value")).join(when, "id")
            parts.append(progress(shown, ["bench", "split"]).select("bench", "split", "id", "at", (F.col("value") * sign).alias("value")))
        out["figures"] = reduce(DataFrame.unionByName, parts)
    return out


def _body(table: BodyTable, of, papers: DataFrame, cells) -> DataFrame:
    """``name, group, place, id, board, cls, value, mark, cells``: the papers of a body table by paradigm.

    Known papers are those that hold a record on a board or lead a paradigm there, the anchors, and with
    ``cites`` those cited as often. Ablations are out. A paper has one group, that of its row on the first board
    it is on; each group shows its best of every board, its anchors and its leaders. Marks are the best and
    second-best values of what is shown.
    """
    signed = lambda b: (F.col("value") * (-1 if b.metric in LOWER_BETTER else 1)).alias("signed")
    strict = rules.is_ablation(F.col("method"), strict=True).alias("strict")
    rows = reduce(DataFrame.unionByName, [of(b).select("id", "pd", "cls", "value", signed(b), strict, "_seq", F.lit(i).alias("board"), cells(b)) for i, b in enumerate(table.boards)])
    by = lambda *c: Window.partitionBy(*c).orderBy(F.col("signed").desc(), "id")
    rows = rows.withColumn("record", F.row_number().over(by("board", "cls")) <= F.when(F.col("cls") == 0, table.records).otherwise(RECORDS_OTHER))
    leads = F.when((F.col("cls") == 0) & ~F.col("strict"), F.row_number().over(by("board", "pd", (F.col("cls") == 0) & ~F.col("strict"))) == 1)
    rows = cut(rows.withColumn("leads", F.coalesce(leads, F.lit(False))), "body_rows")
    names = F.array(*map(F.lit, table.anchors)) if table.anchors else F.array().cast("array<string>")
    key = F.col("key") if "key" in papers.columns else F.lit(None).cast("string")
    anchor = F.coalesce(F.array_contains(names, F.col("n")), F.lit(False)) | F.coalesce(F.array_contains(names, key), F.lit(False))
    much = F.coalesce(F.col("c") >= table.cites, F.lit(False)) if table.cites is not None else F.lit(False)
    of_paper = rows.groupBy("id").agg(F.bool_or("record").alias("record"), F.bool_or("leads").alias("leader"))
    of_paper = of_paper.join(papers.select("id", anchor.alias("anchor"), much.alias("much")), "id", "left").na.fill(False, ["anchor", "much"])
    seen = rows.drop("record", "leads").join(of_paper.where("record or leader or anchor or much"), "id").where("not strict")
    first = seen.groupBy("id").agg(F.min_by("pd", "board").alias("group"), F.min(F.struct("board", "cls", -F.col("signed"))).alias("at"))
    seen = seen.join(first, "id")
    nth = F.row_number().over(Window.partitionBy("board", "group").orderBy("cls", F.col("signed").desc(), "_seq"))
    most = F.when(F.col("group") == "none", 0).when(F.col("board") == 0, table.per_group).otherwise(table.per_group_other)
    seen = seen.withColumn("top", nth <= most)
    chosen = seen.groupBy("id").agg(F.bool_or(F.col("top") | F.col("anchor") | (F.col("leader") & (F.col("group") != "none"))).alias("in")).where("in").select("id")
    shown = seen.join(chosen, "id", "left_semi")
    place = F.dense_rank().over(Window.partitionBy("group").orderBy("at", "id"))
    mark = F.dense_rank().over(Window.partitionBy("board", "cls").orderBy(F.col("signed").desc()))
    return shown.select(F.lit(table.name).alias("name"), "group", place.alias("place"), "id", "board", "cls", "value", F.when((F.col("cls") == 0) & (mark <= 2), mark).alias("mark"), "cells")
