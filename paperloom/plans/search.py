"""The search language and its compilation to Columns: terms, fields, facets, orders.

``parse`` runs on the driver and yields a small tree; everything else is a Column, so
filters reach the scan and one query is one plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that a query may put before a colon, and the column each looks into.
FIELDS = {"task": "tk", "tk": "tk", "pd": "pd", "paradigm": "pd", "bench": "bm", "bm": "bm", "venue": "v", "co": "co", "org": "co", "industry": "co", "year": "y", "author": "a", "au": "a", "name": "n", "id": "id"}
_ITEM = re.compile(r'(-)?(?:(\w+):)?(?:"([^"]*)"|(\S+))')


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    fields: tuple[tuple[str, str, bool], ...] = ()  # column, value, negated


def parse(text: str) -> Query:
    """``task:VLN year:>=2024 -word "a phrase"``.

    A name that is no field makes ``name:value`` a term; behind a minus its value alone is.
    """
    terms, without, fields = [], [], []
    for minus, name, phrase, word in _ITEM.findall(text or ""):
        value = (phrase or word).lower()
        if name and name.lower() in FIELDS:
            if value:
                fields.append((FIELDS[name.lower()], value, bool(minus)))
            continue
        if value and minus:
            without.append(value)
        elif value:
            terms.append(f"{name.lower()}:{value}" if name else value)
    return Query(tuple(terms), tuple(without), tuple(fields))


def _holds(part: str):
    return lambda x: F.contains(F.lower(x), F.lit(part))


def _entry(facet: str):
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value"))


def year_matches(y: Column, value: str) -> Column:
    """>=Y, <=Y, >Y, <Y, Y and Y1-Y2; anything else holds for every row."""
    m = re.fullmatch(r"(>=|<=|>|<)?(\d{4})(?:-(\d{4}))?", value)
    if not m:
        return F.lit(True)
    n = int(m[2])
    if m[3]:
        return y.between(n, int(m[3]))
    return {">=": y >= n, "<=": y <= n, ">": y > n, "<": y < n, None: y == n}[m[1]]


def field_matches(df: DataFrame, column: str, value: str) -> Column:
    if column == "y":
        return year_matches(F.col("y"), value)
    if column == "id":
        return F.startswith(F.lower(F.col("id").cast("string")), F.lit(value))
    if column == "v":
        return F.contains(F.lower(F.coalesce("v", F.lit("preprint"))), F.lit(value))
    if column == "co" and value in ("any", "yes"):
        value = ""
    if dict(df.dtypes)[column].startswith("array"):
        return F.coalesce(F.exists(F.col(column), _holds(value)), F.lit(False))
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lit(value)), F.lit(False))


def haystack(*columns: Column) -> Column:
    """One lower-case text to look terms up in; nulls keep their place as empty texts."""
    return F.lower(F.concat_ws(" \u0001 ", *(F.coalesce(c, F.lit("")) for c in columns)))


def matches(df: DataFrame, query: Query, hay: str = "_h") -> Column:
    tests = [F.contains(F.col(hay), F.lit(t)) for t in query.terms]
    tests += [~F.contains(F.col(hay), F.lit(t)) for t in query.without]
    for column, value, negated in query.fields:
        hit = field_matches(df, column, value)
        tests.append(~hit if negated else hit)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True)
class Facet:
    """A facet's values for a row, as an array column expression."""

    name: str
    values: Column
    order: tuple[str, ...] = ()
    top: int = 0


def scalar(column: str, default: str | None = None) -> Column:
    value = F.col(column) if default is None else F.coalesce(F.col(column), F.lit(default))
    return F.filter(F.array(value), lambda x: x.isNotNull())


def many(column: str, default: str | None = None) -> Column:
    values = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return values if default is None else F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(default)))


@dataclass(frozen=True)
class Spec:
    """A whole request: query, selected facet values (empty: no filter), order and page."""

    query: Query = Query()
    selected: dict = field(default_factory=dict)
    sort: str = "auto"
    limit: int = 60
    offset: int = 0


def passes(facets: list[Facet], selected: dict, but: str | None = None) -> Column:
    """OR inside a facet, AND across facets, ``but`` left out."""
    tests = [F.arrays_overlap(f.values, F.array(*map(F.lit, selected[f.name]))) for f in facets if selected.get(f.name) and f.name != but]
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def facet_counts(df: DataFrame, facets: list[Facet], spec: Spec, hay: str = "_h") -> DataFrame:
    """``facet, value, n``: counts under every selection but the facet's own, in one scan.

    A row carries the number of facets that it fails and, for each facet, whether it fails
    it; it counts for a facet if it fails no other. The rows of all facets are exploded
    once and aggregated with partial sums, so the input is read once and not once a facet.
    """
    fails = {f.name: ~F.coalesce(F.arrays_overlap(f.values, F.array(*map(F.lit, spec.selected[f.name]))), F.lit(False)) if spec.selected.get(f.name) else F.lit(False) for f in facets}
    failed = reduce(lambda a, b: a + b, [x.cast("int") for x in fails.values()])
    entries = F.flatten(F.array(*(F.when(F.col("__failed") == fails[f.name].cast("int"), F.transform(F.array_distinct(f.values), _entry(f.name))).otherwise(F.array().cast("array<struct<facet:string,value:string>>")) for f in facets)))
    rows = df.where(matches(df, spec.query, hay)).withColumn("__failed", failed)
    return rows.select(F.explode(entries).alias("e")).groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))


def shown_options(counts: DataFrame, selected: list[str], top: int) -> DataFrame:
    """The ``top`` most frequent values and all selected ones."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("rank", rank).where((F.col("rank") <= top) | F.col("value").isin(selected))


def relevance(terms: tuple[str, ...], name: str = "n", title: str = "t", summary: str = "tl", authors: str = "a", cites: str = "c", year: str = "y") -> Column:
    """Points a term: name equals 60, contains 25, title 10, summary 4, an author 5, and 1 for each; then citations and freshness."""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    points = F.lit(0.0)
    for t in terms:
        points = points + (
            F.when(text(name) == t, 60).when(F.contains(text(name), F.lit(t)), 25).otherwise(0)
            + F.when(F.contains(text(title), F.lit(t)), 10).otherwise(0)
            + F.when(F.contains(text(summary), F.lit(t)), 4).otherwise(0)
            + F.when(F.exists(F.col(authors), _holds(t)), 5).otherwise(0)
            + 1
        )
    return points + 0.9 * F.log1p(F.coalesce(F.col(cites), F.lit(0))) + F.when(F.col(year) >= 2024, 0.6).otherwise(0.0)


def order_by(sort: str, terms: tuple[str, ...]) -> list[Column]:
    """Sort keys; ``auto`` is by relevance if there are terms, else newest first. The id settles ties."""
    if sort == "auto":
        sort = "relevance" if terms else "new"
    last = F.coalesce(F.element_at(F.split(F.trim(F.lower(F.try_element_at(F.col("a"), F.lit(1)))), r"\s+"), -1), F.lit("~"))
    keys = {
        "relevance": [relevance(terms).desc(), F.col("d").desc()],
        "new": [F.col("d").desc()],
        "old": [F.col("d").asc()],
        "cited": [F.col("c").desc()],
        "title": [F.lower("t").asc()],
        "author": [last.asc(), F.col("y").desc()],
        "added": [F.col("fs").desc(), F.col("d").desc()],
    }
    return [*keys[sort], F.col("id").asc()]


def search(df: DataFrame, facets: list[Facet], spec: Spec, hay: str = "_h") -> DataFrame:
    """One page of results; the planner turns it into a top-k without a full sort."""
    found = df.where(matches(df, spec.query, hay) & passes(facets, spec.selected)).orderBy(*order_by(spec.sort, spec.query.terms))
    return (found.offset(spec.offset) if spec.offset else found).limit(spec.limit)


def pooled_years(df: DataFrame, low: int, high: int, floor: int) -> Column:
    """A year slider: its lower end pools all that is older, year 0 is unknown and never in."""
    y = F.col("y")
    return (y > 0) & (y <= high) & ((y >= low) | F.lit(low <= floor))


def slider_floor(df: DataFrame, start: int) -> DataFrame:
    """The year below which 1 % of the rows lie, but not more than six years before ``start``."""
    return df.where("y > 0").agg(F.greatest(F.percentile("y", 0.01).cast("int"), F.lit(start - 6)).alias("floor"))


def local_matches(df: DataFrame, question: str, stop: list[str], k: int = 12, hay: str = "_h") -> DataFrame:
    """The static site's search: points a term for name (6), title (3) and anywhere (1), then citations and scope."""
    terms = sorted({w for w in re.split(r"[^a-z0-9+.-]+", question.lower()) if len(w) > 1 and w not in stop})
    if not terms:
        return df.limit(0).withColumn("score", F.lit(0.0))
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    hits = reduce(lambda a, b: a + b, [F.when(F.contains(x, F.lit(t)), w).otherwise(0) for t in terms for x, w in ((text("n"), 6), (text("t"), 3), (F.col(hay), 1))])
    rows = df.where("sc <> 'out'").withColumn("__hits", hits).where("__hits > 0")
    score = F.col("__hits") + 0.3 * F.log1p(F.coalesce("c", F.lit(0))) + F.when(F.col("sc") == "core", 1).otherwise(0)
    return rows.withColumn("score", score).drop("__hits").orderBy(F.col("score").desc(), "id").limit(k)


def is_new(first_seen: Column, built: Column, bulk: str = "", days: int = 10) -> Column:
    return F.coalesce((first_seen > F.lit(bulk)) & (F.datediff(built, F.to_date(first_seen)) <= days), F.lit(False))


def published_venues(papers: DataFrame, venue: str = "vn", none: str = "Preprint") -> DataFrame:
    """All venues but that of preprints."""
    return papers.select(F.coalesce(venue, F.lit(none)).alias("venue")).distinct().where(F.col("venue") != none)


def merged_spec(base: dict[str, list], own: dict[str, list]) -> dict[str, list]:
    """A section's request over its survey's: its own facets replace the survey's, others stay."""
    return {**base, **own}


def merged_map(base: Column, own: Column) -> Column:
    """Two maps as one; the second's value wins where both have a key."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


# ---- fixed values: how many a list shows -------------------------------------------------
SHOWN = {"excluded": 80, "jobs": 30, "benches": 80, "venues": 40}
# ------------------------------------------------------------------------------------------


def shown(rows: DataFrame, kind: str, *order: Column | str) -> DataFrame:
    """As many rows as a list of this kind shows, in order; a top-k that no task sorts whole."""
    return rows.orderBy(*order).limit(SHOWN[kind])


def excluded_search(excluded: DataFrame, term: str, limit: int = SHOWN["excluded"]) -> DataFrame:
    """Dropped papers whose title holds the term; without one, those that the reader put out."""
    hit = F.contains(F.lower("t"), F.lit(term.lower())) if term else F.col("why") == "llm:out"
    return excluded.where(hit).orderBy("id").limit(limit)


def to_state(spec: Spec, text: str, default_scope: tuple[str, ...] = ("core",)) -> str:
    """A request as a query string; what is at its default is left out."""
    from urllib.parse import urlencode

    pairs = [("q", text)] if text else []
    for name, values in spec.selected.items():
        if name == "sc":
            if sorted(values) != sorted(default_scope):
                pairs.append((name, ",".join(values) if values else "any"))
        elif values:
            pairs.append((name, ",".join(values)))
    if spec.sort != "auto":
        pairs.append(("sort", spec.sort))
    return urlencode(pairs)


def from_state(state: str, facets: list[str], default_scope: tuple[str, ...] = ("core",)) -> Spec:
    from urllib.parse import parse_qs

    got = {k: v[0] for k, v in parse_qs(state).items()}
    chosen = {k: got[k].split(",") for k in facets if k in got and k != "sc"}
    scope = got.get("sc")
    chosen["sc"] = list(default_scope) if scope is None else [] if scope == "any" else scope.split(",")
    return Spec(parse(got.get("q", "").lower()), chosen, got.get("sort", "auto"))
