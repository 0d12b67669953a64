"""The leaderboard: result rows, verdicts, composite ranks, records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import LOWER_BETTER, METRIC_ORDER, percent, strip_other
from paperloom.sources.staging import cut

# ---- fixed values ------------------------------------------------------------------
NOT_STANDARD = r"(?i)beam|pre-?explor|ensemble|test[- ]time aug|ground[- ]truth|\bGT\b|oracle|privileged|pre-?built map|prior map|known map|teleport|full observ|panoramic action space in continuous"
DENIED = r"(?i)\b(no|without|not using|not|w/o|free of)\s+(the\s+)?(simulator\s+)?(ground[- ]truth|GT|oracle|privileged|pre-?explor\w*|beam)[\w -]{0,20}"
ABLATION = r"(?i)w/o|without|\bno\b|ablation|\bonly\b|variant|†|tokens per|\bbaseline\b|, (?!and\b)"
ABLATION_STRICT = r"(?i)w/o|without|ablation|\bonly\b|\bvariant\b"
# ------------------------------------------------------------------------------------


def explode_numbers(readings: DataFrame, papers: DataFrame, bench_alias: DataFrame | None = None, metric_alias: dict[str, str] | None = None) -> DataFrame:
    """Result rows of nested notes, in the fixed order: explode, clean names, aliases."""
    rows = readings.select("uid", F.explode("numbers").alias("x")).select(F.col("uid").alias("id"), "x.*").where(F.size("metrics") > 0)
    rows = rows.withColumn("bench", strip_other(F.col("bench")))
    if bench_alias is not None:
        rows = rows.join(bench_alias.select(F.col("alias").alias("bench"), F.col("name").alias("__to")), "bench", "left").withColumn("bench", F.coalesce("__to", "bench")).drop("__to")
    return rows.withColumn("metrics", rename_metrics(F.col("metrics"), metric_alias or {})).join(papers, "id")


def _renamed(old: str, new: str):
    return lambda k, v: F.when(k == old, F.lit(new)).otherwise(k)


def rename_metrics(m: Column, aliases: dict[str, str]) -> Column:
    """Old metric names become new ones where the new one is absent; no key is made twice."""
    for old, new in aliases.items():
        renamed = F.transform_keys(m, _renamed(old, new))
        m = F.when(F.map_contains_key(m, F.lit(old)) & ~F.map_contains_key(m, F.lit(new)), renamed).otherwise(m)
    return m


def nonstandard(audit_std: Column, cmp: Column, priv: Column, extra: Column) -> Column:
    """Audit before judge before words; words denied ("no ground truth") do not count."""
    p = F.regexp_replace(F.trim(F.coalesce(priv, F.lit(""))), DENIED, "")
    e = F.regexp_replace(F.coalesce(extra, F.lit("")), DENIED, "")
    said = (p.rlike(NOT_STANDARD) & ~p.rlike(r"(?i)^none")) | e.rlike(NOT_STANDARD)
    return F.coalesce(~audit_std, ~cmp, said)


def consistent(m: Column, slack: float = 0.05) -> Column:
    """False where SPL exceeds SR, or OSR falls below it, by more than ``slack``."""
    of = lambda k: percent(F.lit(k), F.try_element_at(m, F.lit(k)))
    sr, spl, osr = of("SR"), of("SPL"), of("OSR")
    return ~F.coalesce(spl > sr + slack, F.lit(False)) & ~F.coalesce(osr < sr - slack, F.lit(False))


def usable(ok: Column, audit_ok: Column, m: Column) -> Column:
    return (F.coalesce(ok, F.lit(False)) | F.coalesce(audit_ok, F.lit(False))) & F.coalesce(audit_ok, F.lit(True)) & consistent(m)


def moved(board: DataFrame) -> DataFrame:
    """(bench, split, id) with a row that the audit found nonstandard."""
    return board.where("audit_std = false").select("bench", "split", "id").distinct()


def comparable(board: DataFrame) -> DataFrame:
    """Adds ``comparable``: the full set, standard, and not an unaudited row of a moved paper."""
    flag = moved(board).withColumn("__moved", F.lit(True))
    out = board.join(flag, ["bench", "split", "id"], "left")
    std = ~nonstandard(F.col("audit_std"), F.col("cmp"), F.col("priv"), F.col("extra"))
    return out.withColumn("comparable", (F.col("eval_set") == "full") & std & ~(F.coalesce("__moved", F.lit(False)) & F.col("audit_std").isNull())).drop("__moved")


def is_ablation(method: Column, strict: bool = False) -> Column:
    return F.coalesce(method, F.lit("")).rlike(ABLATION_STRICT if strict else ABLATION)


def direction(metric: Column) -> Column:
    """1 where more is better, -1 where less is."""
    return F.when(metric.isin(*LOWER_BETTER), -1).otherwise(1)


def best_rows(board: DataFrame, value: Column, better: Column | int = 1, rank_first: list[Column] | None = None, tie: str = "_seq", by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Each paper's best row: by classes, then value in its direction, then order."""
    keys = [*(rank_first or []), (value * better).desc(), F.col(tie).asc()]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
    return board.where(value.isNotNull()).withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def top_blocks(rows: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """The ``top`` comparable rows and ``max(8, top // 3)`` others of each bench and split, where at least three are comparable."""
    w = Window.partitionBy("bench", "split")
    nth = F.row_number().over(Window.partitionBy("bench", "split", "comparable").orderBy(*order))
    out = rows.withColumn("rank", nth).withColumn("__n", F.count_if("comparable").over(w))
    return out.where((F.col("__n") >= 3) & (F.col("rank") <= F.when(F.col("comparable"), top).otherwise(max(8, top // 3)))).drop("__n")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each group; Spark limits the groups before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def records(rows: DataFrame, group: list[str], order: list[Column], value: str, higher: bool = True) -> DataFrame:
    """Rows that beat everything before them in their group, with the record before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.max if higher else F.min)(value).over(w)
    start = F.lit(-1.0 if higher else float("inf"))
    out = rows.withColumn("before", F.coalesce(best, start))
    return out.where(F.col(value) > F.col("before") if higher else F.col(value) < F.col("before"))


def best_and_second(rows: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Place 1 and 2 over distinct values: what a table prints bold and underlined."""
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*group).orderBy(value.desc()))).where("place <= 2")


def metric_coverage(board: DataFrame, share: float = 0.25, most: int = 7) -> DataFrame:
    """Metrics of each bench and split that enough rows have, preferred ones first."""
    total = board.groupBy("bench", "split").agg(F.count(F.lit(1)).alias("total"))
    n = board.select("bench", "split", F.explode(F.map_keys("m")).alias("metric")).groupBy("bench", "split", "metric").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, METRIC_ORDER)), F.col("metric"))
    known = n.join(total, ["bench", "split"]).where(F.col("n") >= share * F.col("total"))
    rank = F.row_number().over(Window.partitionBy("bench", "split").orderBy(F.when(place == 0, 99).otherwise(place), F.col("n").desc(), "metric"))
    return known.withColumn("rank", rank).where(F.col("rank") <= most)


def mode_of(rows: DataFrame, group: list[str], value: str, order: str = "_seq") -> DataFrame:
    """The most frequent value of each group; the one seen first wins ties."""
    n = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return n.groupBy(*group).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "seen")).alias(value))


def filters(bench=None, split=None, eval_set=None, zero_shot=None, open_weights=None, verified=None, standard=None, paradigms=None) -> Column:
    """A conjunction of the board's filters; null never equals an asked-for weight."""
    test = F.lit(True)
    for column, value in (("bench", bench), ("split", split), ("eval_set", eval_set)):
        if value is not None:
            test &= F.col(column) == value
    if zero_shot is not None:
        test &= F.coalesce("zs", F.lit(False)) == zero_shot
    if open_weights is not None:
        test &= F.coalesce(F.col("open") == open_weights, F.lit(False))
    if verified:
        test &= F.coalesce("ok", F.lit(False))
    if standard:
        test &= ~nonstandard(F.col("audit_std"), F.col("cmp"), F.col("priv"), F.col("extra"))
    return test & F.col("pd").isin(paradigms) if paradigms else test


#: The split that a page opens with where a board has it, and the metric it is sorted by (fixed values).
FIRST_SPLIT, FIRST_METRIC = "val-unseen", "SR"
#: What a metric's text begins with that is a number.
NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


@dataclass(frozen=True)
class Page:
    """A leaderboard as it is shown: which board, its metrics in order, what it is sorted by, and the rows."""

    bench: str | None
    split: str | None
    metrics: tuple[str, ...]
    key: str | None
    rows: DataFrame


def page(board: DataFrame, bench: str | None = None, split: str | None = None, sort: str | None = None, ascending: bool | None = None, **kept) -> Page:
    """One board: filtered by ``kept`` (see ``filters``), its metrics by coverage, ranked by one of them.

    A benchmark or split that is not given, or that the board lacks, is the one with most rows,
    the first seen among equals; a split of the usual name comes before it. Metrics are those that a
    quarter of all rows of the board has. Rows without a number for the key come last; ties are in
    the board's order. What the driver sees are names: one benchmark, one split, seven metrics.
    """

    def most(rows: DataFrame, column: str, wanted: str | None, usual: str | None = None) -> str | None:
        counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("seen"))
        rank = F.when(F.col(column) == F.lit(wanted), 0).when(F.col(column) == F.lit(usual), 1).otherwise(2)
        first = counts.orderBy(rank, F.col("n").desc(), "seen").first()
        return first[column] if first else None

    bench = most(board, "bench", bench)
    of_bench = board.where(F.col("bench") == F.lit(bench))
    split = most(of_bench, "split", split, FIRST_SPLIT)
    own = of_bench.where(F.col("split") == F.lit(split))
    metrics = tuple(r["metric"] for r in metric_coverage(own).orderBy("rank").collect())
    key = sort if sort in metrics else FIRST_METRIC if FIRST_METRIC in metrics else metrics[0] if metrics else None
    up = ascending if ascending is not None and sort == key else key in LOWER_BETTER
    value = F.regexp_extract(F.coalesce(F.try_element_at("m", F.lit(key)), F.lit("")), NUMBER, 1).try_cast("double")
    rows = own.where(filters(**kept)).withColumn("value", value)
    order = [F.col("value").asc_nulls_last() if up else F.col("value").desc_nulls_last(), F.col("_seq")]
    cells = F.map_filter("m", lambda k, _: k.isin(*metrics)) if metrics else F.col("m")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bench", "split").orderBy(*order))).withColumn("cells", cells)
    return Page(bench, split, metrics, key, ranked)


def audit_head(board: DataFrame, cache: DataFrame, top: int = 8, rounds: int = 5, verdict=None) -> DataFrame:
    """Rows at the head of each board that no audit has seen.

    With a ``verdict`` function (rows to cache rows) this goes on, up to ``rounds``
    times: a row found bad lets the next one in, until the head is all audited. Each
    round is a written table's worth of rows, never the board.
    """
    order = [F.col("value").desc(), F.col("key")]
    # no round looks beyond the first top * (rounds + 1) rows of a board
    near = board if verdict is None else cut(top_per_group(board, ["bench", "split"], order, top * (rounds + 1)), "board")
    for _ in range(rounds if verdict else 1):
        good = near.join(cache.where("audit_ok = false").select("key"), "key", "left_anti")
        head = top_per_group(good, ["bench", "split"], order, top)
        open_ = head.join(cache.select("key"), "key", "left_anti")
        if verdict is None:
            return open_
        found = cut(verdict(open_), "verdicts")
        if found.isEmpty():
            break
        cache = cache.unionByName(found)
    return head


def notable(anchors: list[str], year: int, cites: int = 50, cites_venue: int = 10) -> Column:
    """Anchors, companies' papers, much cited ones, published ones with some uptake or of this year."""
    c = F.coalesce("c", F.lit(0))
    need = F.when(F.col("vk") == "other", 2 * cites_venue).otherwise(cites_venue)
    fresh = (F.col("vk") == "main") & (F.coalesce(F.regexp_extract("v", "(20[0-9]{2})", 1).try_cast("int"), F.lit(0)) >= year)
    published = F.col("v").isNotNull() & (F.coalesce("vk", F.lit("")) != "workshop") & ((c >= need) | F.coalesce(fresh, F.lit(False)))
    anchor = F.col("key").isin(anchors) | F.coalesce("n", F.lit("")).isin(anchors)
    return anchor | (F.size(F.coalesce("co", F.array().cast("array<string>"))) > 0) | (c >= cites) | published


def worthy(named: Column, cites: Column, cited_in_body: Column, least: int = 50) -> Column:
    """A row that earns its reference: its work has a name, is much cited, or is discussed."""
    return named | (F.coalesce(cites, F.lit(0)) >= least) | cited_in_body


def bench_variant(dims: list[tuple[str, str, str]], fields: list[str]) -> Column:
    """A variant by declared rules (bench, pattern, variant), fields in their order of priority."""
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        for bench, pattern, variant in reversed(dims):
            out = F.when((F.col("bench") == bench) & F.coalesce(F.col(f), F.lit("")).rlike(pattern), variant).otherwise(out)
    return out
