"""Pivots, timelines, windows over time, author profiles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import strip_marks


def map_counts(papers: DataFrame, tasks: str = "tk", paradigm: str = "pd") -> DataFrame:
    """``task, paradigm, n`` with totals: a null task or paradigm is the margin.

    Papers have several tasks, so margins count papers once: a paper's cells and margins are found where
    its rows are, and are counted before anything is shuffled.
    """
    none = F.lit(None).cast("string")
    cell = lambda task, pd, margin: F.struct(task.cast("string").alias("task"), pd.cast("string").alias("paradigm"), F.lit(margin).alias("margin"))
    own = papers.groupBy("id").agg(F.collect_set(F.struct(F.coalesce(tasks, F.array().cast("array<string>")).alias("tasks"), F.col(paradigm).alias("paradigm"))).alias("rows"))  # a paper's rows
    cells = own.select(F.flatten(F.transform("rows", lambda r: F.transform(r["tasks"], lambda x: cell(x, r["paradigm"], 0)))).alias("cells"))
    margins = (F.transform("cells", lambda x: cell(x["task"], none, 1)), F.transform("cells", lambda x: cell(none, x["paradigm"], 2)), F.transform("cells", lambda x: cell(none, none, 3)))
    each = cells.select(F.explode(F.array_distinct(F.concat("cells", *margins))).alias("x")).select("x.*")
    return each.groupBy("task", "paradigm", "margin").agg(F.count(F.lit(1)).alias("n")).drop("margin")


def pivot(papers: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """A dense matrix with the given columns, zeros filled in."""
    return papers.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def dense_cells(tasks: DataFrame, paradigms: DataFrame, counts: DataFrame) -> DataFrame:
    """All cells of two small dimensions, empty ones with 0: one row of all paradigms meets the tasks."""
    every = paradigms.agg(F.array_sort(F.collect_set("paradigm")).alias("all"))
    cells = tasks.select("task").join(F.broadcast(every)).select("task", F.explode("all").alias("paradigm"))
    return cells.join(counts, ["task", "paradigm"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def year_counts(papers: DataFrame, by: str = "pd") -> DataFrame:
    """``y, by, n, total, share`` and the stacked interval ``low`` to ``high``."""
    year = Window.partitionBy("y")
    stack = year.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = papers.where("y > 0").groupBy("y", by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(year)).withColumn("share", F.col("n") / F.col("total")).withColumn("high", F.sum("n").over(stack)).withColumn("low", F.col("high") - F.col("n"))


def within(date: Column, ref: Column, from_days: int, to_days: int) -> Column:
    """date in (ref - to, ref - from]."""
    return (date > F.date_sub(ref, to_days)) & (date <= F.date_sub(ref, from_days))


def paper_date(d: Column, y: Column) -> Column:
    """A paper's day, the first of July where only its year is known."""
    return F.coalesce(F.try_to_date(d), F.when(y > 0, F.make_date(y, F.lit(7), F.lit(1))))


def growth(papers: DataFrame, by: str, ref: Column, days: int = 365) -> DataFrame:
    """Counts of the last window and the one before, and their relative change."""
    out = papers.groupBy(by).agg(F.count_if(within(F.col("date"), ref, 0, days)).alias("now"), F.count_if(within(F.col("date"), ref, days, 2 * days)).alias("then"))
    return out.withColumn("growth", F.when(F.col("then") > 0, (F.col("now") - F.col("then")) / F.col("then")))


def share_shift(papers: DataFrame, codes: str, ref: Column, days: int = 365, least: int = 5, share: float = 0.02) -> DataFrame:
    """Share of papers with a code, now and before; rare codes are left out."""
    now, then = within(F.col("date"), ref, 0, days), within(F.col("date"), ref, days, 2 * days)
    base = papers.agg(F.count_if(now).alias("n_now"), F.count_if(then).alias("n_then"))
    out = papers.select("id", "date", F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count_if(now).alias("n"), F.count_if(then).alias("m"))
    out = out.join(F.broadcast(base)).select("code", "n", (F.col("n") / F.nullif(F.col("n_now"), F.lit(0))).alias("now"), (F.col("m") / F.nullif(F.col("n_then"), F.lit(0))).alias("before"))
    return out.where((F.col("n") >= least) | (F.col("now") >= share))


def monthly_average(papers: DataFrame, first: str, last: str, rows: int = 6) -> DataFrame:
    """Papers a month over the whole calendar, and the mean of the last ``rows`` months."""
    spark = papers.sparkSession
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("month"))
    n = papers.groupBy(F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    trailing = Window.orderBy("month").rowsBetween(1 - rows, 0)  # a row for each month
    return months.join(n, "month", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("average", F.avg("n").over(trailing))


def monthly_rate(cites: Column, date: Column, ref: Column) -> Column:
    """Citations a month of 30.44 days, an age of one at least."""
    return cites / F.greatest(F.lit(1.0), F.datediff(ref, date) / F.lit(30.44))


def fractional_year(d: Column, y: Column, half: bool = False) -> Column:
    month = F.substring(d, 6, 2).try_cast("int")
    return y + F.coalesce((month - (0.5 if half else 1)) / 12, F.lit(0.5))


def author_index(papers: DataFrame) -> DataFrame:
    """``author, n, first, last, core`` over exploded authors."""
    rows = papers.select("y", "sc", F.explode("a").alias("author"))
    known = F.when(F.col("y") > 1900, F.col("y"))
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("first"), F.max(known).alias("last"), F.count_if(F.col("sc") == "core").alias("core"))


def coauthors(papers: DataFrame, author: str, top: int = 8) -> DataFrame:
    mine = papers.where(F.array_contains("a", author)).select(F.explode(F.filter("a", lambda x: x != author)).alias("coauthor"))
    return mine.groupBy("coauthor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "coauthor").limit(top)


def author_profile(papers: DataFrame, author: str) -> DataFrame:
    mine = papers.where(F.array_contains("a", author))
    return mine.agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.element_at("a", 1) == author).alias("first_author"),
        F.sum("c").alias("cites"),
        F.min(F.when(F.col("y") > 1900, F.col("y"))).alias("first"),
        F.max(F.when(F.col("y") > 1900, F.col("y"))).alias("last"),
        F.max_by("t", F.struct("c", "id")).alias("top_paper"),
    )


def author_venues(papers: DataFrame, author: str, top: int = 6) -> DataFrame:
    """Where an author publishes most, preprints left out."""
    mine = papers.where(F.array_contains("a", author) & F.col("vn").isNotNull())
    return mine.groupBy(F.col("vn").alias("venue")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "venue").limit(top)


def author_paradigms(papers: DataFrame, author: str) -> DataFrame:
    """An author's papers by paradigm and year."""
    return papers.where(F.array_contains("a", author)).groupBy("pd", "y").agg(F.count(F.lit(1)).alias("n"))


def scale_colour(n: Column, most: Column) -> Column:
    """Strength of a cell on a map: from 0.07 up to 1 by the root of its share of the greatest."""
    return F.when((most > 0) & (n > 0), F.lit(0.07) + 0.93 * F.sqrt(n / most)).otherwise(F.lit(0.0))


def nice_step(most: Column, steps: int = 4) -> Column:
    """The step of an axis up to ``most``: 1, 2 or 5 times a power of ten."""
    raw = F.greatest(most / steps, F.lit(1e-12))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return power * F.when(raw / power <= 1, 1).when(raw / power <= 2, 2).when(raw / power <= 5, 5).otherwise(10)


def autocomplete(index: DataFrame, term: str, top: int = 8) -> DataFrame:
    """Authors whose folded name holds the term: prefix first, then word starts, then by papers."""
    t = "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))
    name = F.lower(strip_marks(F.col("author")))
    rank = F.when(F.startswith(name, F.lit(t)), 0).when(F.contains(name, F.lit(" " + t)), 1).otherwise(2)
    if len(t) < 2:
        return index.limit(0).withColumn("rank", F.lit(0))
    return index.where(F.contains(name, F.lit(t))).withColumn("rank", rank).orderBy("rank", F.col("n").desc(), "author").limit(top)


def bench_catalogue(papers: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """Benchmarks with counts and first years: known ones in their group, others from ``least`` papers on."""
    n = papers.select("y", F.explode(F.array_distinct("bm")).alias("bench")).groupBy("bench").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("first"))
    out = n.join(known, "bench", "left").withColumn("group", F.coalesce("group", F.lit("other")))
    return out.where((F.col("group") != "other") | (F.col("n") >= least))


def first_year_with(papers: DataFrame, least: int = 20) -> DataFrame:
    """The first year that has enough papers."""
    return papers.where("y > 0").groupBy("y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).agg(F.min("y").alias("y"))


#: Method papers that a year needs for its shares to be shown, benchmarks listed, years back that a line's share is compared with (fixed values).
LEAST_OF_YEAR, BENCHES_SHOWN, YEARS_BACK = 20, 10, 4


def summary(papers: DataFrame, ref: Column, months: tuple[str, str], line: list[str], real: str = "real", none: str = "none") -> dict[str, DataFrame]:
    """The parts of a library's first page, all over its core papers.

    ``tiles`` is one row: papers in all, in the last twelve months and the twelve before, their growth, the share
    of a ``line`` of paradigms among recent method papers and four years ago, of papers in the setting ``real`` now and
    before, and of those with industry. ``tasks``, ``contribs``, ``traits`` and ``settings`` are shares then and now, the last
    two among method papers; ``benches`` the most used of the last year; ``momentum`` papers a month with a
    six-month mean; ``shares`` the paradigms of each year from the first with enough method papers on. ``papers``
    has a ``date``; a paper without one is in no window.
    """
    core = papers.where("sc = 'core'")
    method = core.where(F.col("pd") != none)  # a null paradigm is none
    now, then, ok = within(F.col("date"), ref, 0, 365), within(F.col("date"), ref, 365, 730), F.coalesce(F.col("pd") != none, F.lit(False))
    old, has = F.col("y") == F.year(ref) - YEARS_BACK, F.coalesce(F.array_contains("st", real), F.lit(False))
    share = lambda of, among: F.count_if(of & among) / F.nullif(F.count_if(among), F.lit(0))
    in_line, industry = F.coalesce(F.col("pd").isin(line), F.lit(False)), F.size(F.coalesce("co", F.array().cast("array<string>"))) > 0
    tiles = core.agg(
        F.count(F.lit(1)).alias("core"), F.count_if(now).alias("last"), F.count_if(then).alias("before"), (F.count_if(now) / F.nullif(F.count_if(then), F.lit(0)) - 1).alias("growth"),
        share(in_line, now & ok).alias("line_now"), share(in_line, old & ok).alias("line_then"), share(has, now & ok).alias("real_now"), share(has, then & ok).alias("real_then"), share(industry, now).alias("industry"),
    )
    used = core.select("date", F.explode("bm").alias("bench")).groupBy("bench").agg(F.count_if(now).alias("now"), F.count_if(then).alias("before")).where("now > 0")
    per_year = year_counts(method)
    enough = first_year_with(method, LEAST_OF_YEAR).select(F.coalesce("y", F.lit(0)).alias("__first"))
    return {
        "tiles": tiles,
        "tasks": share_shift(core, "tk", ref),
        "contribs": share_shift(core, "ct", ref),
        "traits": share_shift(method, "tr", ref),
        "settings": share_shift(method, "st", ref),
        "benches": used.orderBy(F.col("now").desc(), "bench").limit(BENCHES_SHOWN),
        "momentum": monthly_average(core, *months),
        "shares": per_year.join(F.broadcast(enough)).where(F.col("y") >= F.col("__first")).drop("__first"),  # one row
    }
