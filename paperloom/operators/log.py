"""Append logs, incremental evaluation and keyed upserts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(log: DataFrame, key: str | list[str], order: str = "_seq") -> DataFrame:
    """The last row of each key. ``row_number = 1`` gets a group limit before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return log.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def first_write(rows: DataFrame, key: str | list[str], order: str = "_seq") -> DataFrame:
    """The first row of each key: the representative of a group."""
    keys = [key] if isinstance(key, str) else key
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def todo(rows: DataFrame, done: DataFrame, key: str, redo: Column | None = None) -> DataFrame:
    """Rows without a result; with ``redo``, a condition on results, also those to do again."""
    settled = done if redo is None else done.where(~F.coalesce(redo, F.lit(False)))
    return rows.join(settled.select(key), key, "left_anti")


def in_scope(rows: DataFrame, labels: DataFrame, key: str, scopes: list[str]) -> DataFrame:
    return rows.join(labels.where(F.col("scope").isin(scopes)).select(key), key, "left_semi")


def stale(found: DataFrame, now: Column, days: int = 21) -> DataFrame:
    """Rows without a venue whose answer is older than ``days``."""
    return found.where(~F.coalesce("venue_ok", F.lit(False)) & (F.col("at") < now - F.make_interval(days=F.lit(days))))


def since(rows: DataFrame, published: str, month: str) -> DataFrame:
    """Rows published in or after a month, by ISO text; a plain comparison reaches the scan."""
    return rows.where(F.col(published) >= month)


def upsert(state: DataFrame, batch: DataFrame, fields: list[str]) -> DataFrame:
    """Merge harvested versions into a state by ``id``, with ``_seq`` as the order of arrival.

    A record's ``fields`` are those of its last arrival among arrivals whose version is no
    smaller than any before; queries are united and the first sighting stays. That fold is
    an arg-max over (version, arrival), so a batch in any order merges in one aggregation.
    """
    rows = state.withColumn("_seq", F.lit(-1).cast("long")).unionByName(batch.select(*state.columns, "_seq"))
    newest = F.struct("version", "_seq")
    packed = F.max_by(F.struct("version", *fields), newest).alias("__r")
    return (
        rows.groupBy("id")
        .agg(packed, F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "queries"))), lambda x: x["queries"]))).alias("queries"), F.min_by("first_seen", "_seq").alias("first_seen"))
        .select("id", "__r.*", "queries", "first_seen")
        .select(*state.columns)
    )


def _among(codes: list[str]):
    return lambda x: x.isin(codes)


def validate_labels(labels: DataFrame, codes: dict[str, list[str]], arrays: list[str], scalars: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Unknown codes leave arrays, scalars fall back, a bad scope rejects the row; duplicates stay."""
    out = labels.where(F.col("scope").isin(codes["scope"]))
    for old, new in (aliases or {}).items():
        out = out.withColumn("paradigm", F.when(F.col("paradigm") == old, F.lit(new)).otherwise(F.col("paradigm")))
    for c in arrays:
        out = out.withColumn(c, F.filter(F.coalesce(c, F.array().cast("array<string>")), _among(codes[c])))
    for c, default in scalars.items():
        out = out.withColumn(c, F.when(F.col(c).isin(codes[c]), F.col(c)).otherwise(F.lit(default)))
    return out


def with_aliases(rows: DataFrame, column: str, aliases: DataFrame, traits: str = "traits") -> DataFrame:
    """Old codes become new ones, with the traits that an alias adds: ``aliases`` is (old, new, extra array)."""
    a = aliases.select(F.col("old").alias("__old"), F.col("new").alias("__new"), F.col("extra").alias("__extra"))
    out = rows.join(a, F.col(column) == F.col("__old"), "left")
    none = F.array().cast("array<string>")
    more = F.array_distinct(F.concat(F.coalesce(traits, none), F.coalesce("__extra", none)))
    return out.withColumn(column, F.coalesce("__new", column)).withColumn(traits, F.when(F.col("__old").isNotNull(), more).otherwise(F.col(traits))).select(*rows.columns)


def override(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Overrides are (key, set: map of field to text); a present null overrides, an absent key does not."""
    joined = rows.join(overrides, key, "left")
    for f in fields:
        there = F.coalesce(F.map_contains_key("set", F.lit(f)), F.lit(False))
        joined = joined.withColumn(f, F.when(there, F.try_element_at(F.col("set"), F.lit(f)).cast(dict(rows.dtypes)[f])).otherwise(F.col(f)))
    return joined.withColumn("override", F.col("set").isNotNull()).drop("set")


def cascade(rows: DataFrame, cheap: Column, sure: Column) -> tuple[DataFrame, DataFrame]:
    """Two tiers: rows that a cheap test keeps, split into settled and those for the second pass."""
    kept = rows.where(cheap)
    return kept.where(F.coalesce(sure, F.lit(False))), kept.where(~F.coalesce(sure, F.lit(False)))


def cache_lookup(cache: DataFrame, key: Column, at: str = "at") -> DataFrame:
    """Latest cached answer of each content hash."""
    return cache.withColumn("__k", F.substring(F.sha1(key), 1, 16)).groupBy("__k").agg(F.max_by(F.struct(*cache.columns), F.col(at)).alias("r")).select("r.*")


def rolling_counts(events: DataFrame, who: str | None, ts: str, seconds: int) -> DataFrame:
    """Adds ``recent``: events of the same visitor (or of all) in the window that ends with each event, itself out.

    Time is cut into cells as long as the window, and every event is copied into the cell after its
    own, to the moment when it leaves the window. All that were copied to a cell are in the window at its
    begin; from there on a running sum adds who comes and takes off who leaves. So one shuffle does, no task
    holds more than two windows of a visitor, its work grows with its rows and not with those in a window, and
    counts are exact across any border.
    """
    t, size = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    cell = F.floor(F.col("__t") / size).cast("long")
    copies = F.array(F.struct(cell.alias("cell"), F.col("__t").alias("at"), F.lit(True).alias("own")), F.struct((cell + 1).alias("cell"), (F.col("__t") + size).alias("at"), F.lit(False).alias("own")))
    both = events.withColumn("__t", t).withColumn("__in", F.explode(copies))
    by_time = Window.partitionBy(*([who] if who else []), "__in.cell").orderBy("__in.at")
    at_first = F.count_if(~F.col("__in.own")).over(by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    since = F.sum(F.when(F.col("__in.own"), 1).otherwise(-1)).over(by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("recent", at_first + since - 1).where("__in.own").select(*events.columns, "recent")


#: Questions of one visitor in an hour, and of all visitors of a site in a day (fixed values).
HOURLY, DAILY = 12, 300


class Admission:
    """What a site has let through in the last day: the state that decides over its next question."""

    def __init__(self, hourly: int, daily: int, at: list[int] = (), who: list = ()):
        self.hourly, self.daily = hourly, daily
        self.let = deque(zip(at, who))
        self.of: dict[object, deque[int]] = {}
        for t, w in self.let:
            self.of.setdefault(w, deque()).append(t)

    def refusal(self, who, at: int) -> str | None:
        """Why a question at a time (microseconds, never falling) is refused; None lets it through. Refused ones do not count."""
        while self.let and at - self.let[0][0] >= 86_400_000_000:
            own = self.of[self.let.popleft()[1]]
            own.popleft()
        if len(self.let) >= self.daily:
            return "daily"
        own = self.of.setdefault(who, deque())
        # at most ``daily`` entries, the latest last
        if sum(1 for t in own if at - t < 3_600_000_000) >= self.hourly:
            return "hourly"
        self.let.append((at, who))
        own.append(at)
        if len(self.of) > 2 * self.daily:
            self.of = {w: q for w, q in self.of.items() if q}
        return None


def admitted(asks: DataFrame, who: str, ts: str, order: str, site: str | None = None, hourly: int = HOURLY, daily: int = DAILY) -> DataFrame:
    """``order, refused``: for each question null, or the limit that refuses it.

    A question is refused if its site let ``daily`` through in the day before, or its visitor
    got ``hourly`` through in the hour before; refused ones count for neither. Questions
    come in the order of ``ts``, then ``order``, a unique key. The site's limit makes one
    sequence of its questions, so a site is sorted and read by one task, which holds no more
    of it than a batch and what was let through in a day; sites are independent.
    """
    rows = asks.select((F.col(site) if site else F.lit("")).alias("site"), F.col(who).cast("string").alias("who"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("order"))
    kind = dict(rows.dtypes)["order"]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_site, state = None, None
        for pdf in batches:
            out = []
            for s, w, t in zip(pdf["site"], pdf["who"], pdf["at"].tolist()):
                if state is None or s != at_site:
                    at_site, state = s, Admission(hourly, daily)
                out.append(state.refusal(w, t))
            yield pd.DataFrame({"order": pdf["order"], "refused": pd.Series(out, dtype=object, index=pdf.index)})

    dealt = rows.where("at is not null and order is not null").repartition("site").sortWithinPartitions("site", "at", "order")
    return dealt.mapInPandas(decide, f"order {kind}, refused string").withColumnRenamed("order", order)


def marks(updates: DataFrame, key: str = "uid", order: str = "_seq") -> DataFrame:
    """Current marks: the last update of a paper, gone if nothing is left in it."""
    latest = last_write(updates, key, order)
    return latest.where(F.coalesce("star", F.lit(False)) | (F.coalesce("status", F.lit("")) != "") | (F.coalesce("note", F.lit("")) != ""))


def starred(papers: DataFrame, marks_: DataFrame, key: str = "id") -> DataFrame:
    """Papers with a star among the current marks."""
    return papers.join(marks_.where(F.coalesce("star", F.lit(False))).select(F.col("uid").alias(key)), key, "left_semi")


def marks_of_libraries(updates: DataFrame, members: DataFrame) -> DataFrame:
    """Current marks of every library that holds the paper: ``members`` is (library, uid)."""
    return members.join(marks(updates), "uid")


def reading_order(papers: DataFrame, known_text: Column, scopes: tuple[str, ...] = ("core", "adjacent")) -> list[Column]:
    """Sort keys of what to read next: papers with a known text first, then by scope, citations and year."""
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("sc"))
    return [F.coalesce(known_text, F.lit(False)).desc(), F.when(rank == 0, len(scopes) + 1).otherwise(rank).asc(), F.coalesce("c", F.lit(0)).desc(), F.coalesce("y", F.lit(0)).desc(), F.col("id").asc()]


def premium(papers: DataFrame, landmarks: DataFrame, top: int) -> DataFrame:
    """Ids that the stronger model reads: landmarks, and the most cited papers."""
    most = papers.orderBy(F.coalesce("c", F.lit(0)).desc(), "id").limit(top).select("id")
    return landmarks.select("id").union(most).distinct()


def to_judge(rows: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys that no verdict is known of: each is judged once, however many rows have it."""
    return rows.select(*key).distinct().join(cache.select(*key), key, "left_anti")


def apply_verdicts(rows: DataFrame, cache: DataFrame, key: list[str], generic: Column, verdict: str, to: str, none: str = "unknown") -> DataFrame:
    """A verdict of the cache replaces ``to`` where the row is still generic and the verdict tells something."""
    out = rows.join(cache.select(*key, F.col(verdict).alias("__v")), key, "left")
    return out.withColumn(to, F.when(generic & F.col("__v").isNotNull() & (F.col("__v") != none), F.col("__v")).otherwise(F.col(to))).drop("__v")


def to_read_again(notes: DataFrame, links: DataFrame, version: str) -> DataFrame:
    """Notes that are not current: of another version, copied, or from an abstract although a text is there.

    ``notes``: uid, version, source, read_at, shared_from, abstract_reason, arxiv_id;
    ``links``: uid, at, of texts found.
    """
    rows = notes.join(links.select("uid", F.col("at").alias("__at")), "uid", "left")
    abstract = F.col("source") == "abstract"
    found_since = abstract & (F.col("__at") > F.col("read_at"))
    failed = abstract & F.col("arxiv_id").isNotNull() & F.col("abstract_reason").isNull()
    other = ~F.col("version").eqNullSafe(F.lit(version))
    return rows.where(F.coalesce(found_since, F.lit(False)) | F.coalesce(failed, F.lit(False)) | F.col("shared_from").isNotNull() | other).drop("__at")


def shared_notes(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Notes to copy from a sibling library: where there are none, or only an older copy.

    Both have uid, version, read_at and shared_from; one's own notes are never replaced.
    """
    own = mine.select("uid", F.col("version").alias("__v"), F.col("read_at").alias("__r"), F.col("shared_from").alias("__s"))
    rows = theirs.join(own, "uid", "left")
    none, copied = F.col("__r").isNull(), F.col("__s").isNotNull()
    newer = (F.col("version") > F.col("__v")) | (F.col("read_at") > F.col("__r"))
    return rows.where(none | (copied & F.coalesce(newer, F.lit(True)))).drop("__v", "__r", "__s")


def coverage(papers: DataFrame, notes: DataFrame) -> DataFrame:
    """Papers and read papers of each scope."""
    rows = papers.join(notes.select("uid").distinct().withColumn("__read", F.lit(True)), "uid", "left")
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("__read", F.lit(False))).alias("read"))


def shared_names(papers: DataFrame, name: str = "n") -> DataFrame:
    """Adds ``namesakes``: how many papers have the same name in any case."""
    return papers.withColumn("namesakes", F.count(name).over(Window.partitionBy(F.lower(name))))


def packs(assigned: DataFrame, papers: DataFrame, tree: DataFrame, roles: list[str], recent_first: bool = False) -> DataFrame:
    """A writer's text for each outline leaf: its papers by year and role, one a line; the newest first for an outlook."""
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    line = F.concat(F.lit("- "), F.coalesce(F.concat("n", F.lit(": ")), F.lit("")), "t", F.lit(" ("), F.col("y").cast("string"), F.lit(")"))
    rows = assigned.join(papers, "id").select("leaf", F.struct((-F.col("y") if recent_first else F.col("y")).alias("y"), rank.alias("rank"), "id", line.alias("line")).alias("r"))
    packed = rows.groupBy("leaf").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    return tree.join(packed, tree.id == packed.leaf).select("leaf", "ord", F.concat(F.lit("# "), "leaf", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text")).orderBy("ord")


# ---- fixed values: what an assignment may say -------------------------------------------
ROLES, LEAST_ROLE, WHY = ("landmark", "representative", "incremental"), "incremental", 160
# -----------------------------------------------------------------------------------------


def unassigned(papers: DataFrame, assigned: DataFrame, again: bool = False) -> DataFrame:
    """Papers of a scope that no assignment of the log names; all of them if they are asked for again."""
    return papers if again else papers.join(assigned.select("id"), "id", "left_anti")


def checked_assignments(answers: DataFrame, asked: DataFrame, leaves: DataFrame, threads: DataFrame, notes: DataFrame) -> DataFrame:
    """Answers fit for the log: of a paper that was asked for, at a leaf that there is.

    ``answers`` is (id, leaf, alt, threads, role, why); an unknown second leaf and unknown threads are left
    out, an unknown role is the least one, reasons are cut, and ``with_reading`` says whether the paper has a note. The
    outline and the notes meet by equality; ``threads`` is as short as an outline.
    """
    rows = answers.join(asked.select("id").distinct(), "id", "left_semi").join(leaves.select("leaf").distinct(), "leaf", "left_semi")
    rows = rows.join(leaves.select(F.col("leaf").alias("__alt")).distinct(), F.col("alt") == F.col("__alt"), "left")
    known = threads.agg(F.coalesce(F.collect_set("thread"), F.array().cast("array<string>")).alias("__threads"))
    rows = rows.join(F.broadcast(known)).join(notes.select(F.col("uid").alias("id"), F.lit(True).alias("__read")).distinct(), "id", "left")  # one row of an outline's threads
    kept = F.filter(F.coalesce("threads", F.array().cast("array<string>")), lambda x: F.array_contains("__threads", x))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(LEAST_ROLE)
    return rows.select("id", "leaf", F.col("__alt").alias("alt"), kept.alias("threads"), role.alias("role"), F.substring(F.coalesce("why", F.lit("")), 1, WHY).alias("why"), F.coalesce("__read", F.lit(False)).alias("with_reading"))
