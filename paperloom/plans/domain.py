"""A field of research as data: vocabularies, aliases, filters, rules and saved requests.

A domain is given by whoever runs a library; nothing in the engine names a field. Small
ordered lists become tables with an explicit order, rules become Columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``then`` where every (column, pattern) matches, every (column, pattern) of ``unless`` does not, and columns equal values."""

    then: str
    matches: tuple[tuple[str, str], ...] = ()
    unless: tuple[tuple[str, str], ...] = ()
    equals: tuple[tuple[str, object], ...] = ()
    before: tuple[str, str] | None = None  # column, first value that is too late

    def holds(self) -> Column:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        tests = [text(c).rlike(p) for c, p in self.matches] + [~text(c).rlike(p) for c, p in self.unless]
        tests += [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in self.equals]
        if self.before:
            tests.append(F.coalesce(F.col(self.before[0]), F.lit("9999")) < self.before[1])
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_rule(rules: tuple[Rule, ...], otherwise: Column) -> Column:
    """What the first rule that holds says; else ``otherwise``."""
    out = otherwise
    for r in reversed(rules):
        out = F.when(r.holds(), F.lit(r.then)).otherwise(out)
    return out


def telling_field(fields: tuple[str, ...], one: tuple[str, str], other: tuple[str, str]) -> Column:
    """The value of that of two (pattern, value) pairs which alone matches the first field that tells them apart; null without one."""
    out = F.lit(None).cast("string")
    for name in reversed(fields):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        a, b = text.rlike(one[0]), text.rlike(other[0])
        out = F.when(a & ~b, F.lit(one[1])).when(b & ~a, F.lit(other[1])).otherwise(out)
    return out


@dataclass(frozen=True)
class Domain:
    """All that a field of research adds to the engine."""

    scopes: tuple[str, ...] = ("core", "adjacent", "out")
    tasks: tuple[tuple[str, str], ...] = ()  # code, label
    paradigms: tuple[tuple[str, str], ...] = ()
    benchmarks: tuple[tuple[str, tuple[str, ...]], ...] = ()  # group, names
    relevant: str = "."  # any case
    strict: str = "."  # any case
    strict_cased: str = r"(?!)"
    categories: tuple[str, ...] = ()  # prefixes
    min_year: int = 2010
    bench_aliases: dict[str, str] = field(default_factory=dict)
    ask_aliases: dict[str, str] = field(default_factory=dict)
    bench_display: dict[str, str] = field(default_factory=dict)
    metric_aliases: dict[str, dict[str, str]] = field(default_factory=dict)  # bench, old, new
    paradigm_aliases: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)  # old, new, traits
    protocols: dict[str, tuple[str, ...]] = field(default_factory=dict)
    bench_variants: dict[str, tuple[Rule, ...]] = field(default_factory=dict)
    table_paradigms: tuple[Rule, ...] = ()
    presets: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    # ---- the prefilter's patterns ------------------------------------------------------

    def is_relevant(self, text: Column) -> Column:
        return text.rlike(f"(?i){self.relevant}")

    def is_strict(self, text: Column) -> Column:
        """A phrase of the field in any case, or an acronym in its own."""
        return text.rlike(f"(?i){self.strict}") | text.rlike(self.strict_cased)

    def is_filed(self, categories: Column) -> Column:
        prefixes = [p for p in self.categories]
        return F.exists(categories, lambda c: reduce(lambda a, b: a | b, [F.startswith(c, F.lit(p)) for p in prefixes], F.lit(False)))

    # ---- vocabularies as tables --------------------------------------------------------

    def codes(self) -> dict[str, list[str]]:
        return {"scope": list(self.scopes), "tasks": [c for c, _ in self.tasks], "paradigm": [c for c, _ in self.paradigms]}

    def dimension(self, spark: SparkSession, name: str) -> DataFrame:
        """``ord, code, label`` of tasks, paradigms or scopes, in their order."""
        rows = [(c, c) for c in self.scopes] if name == "scopes" else list(getattr(self, name))
        return spark.createDataFrame([(i, c, label) for i, (c, label) in enumerate(rows)], "ord int, code string, label string")

    def known_benchmarks(self, spark: SparkSession) -> DataFrame:
        rows = [(b, g) for g, names in self.benchmarks for b in names]
        return spark.createDataFrame(rows, "bench string, group string")

    def aliases(self, spark: SparkSession, asking: bool = False) -> DataFrame:
        """``alias, name`` of benchmarks; with ``asking`` also what only questions call them."""
        pairs = {**self.bench_aliases, **(self.ask_aliases if asking else {})}
        return spark.createDataFrame(list(pairs.items()), "alias string, name string")

    # ---- rules of result rows ------------------------------------------------------------

    def variant(self, bench: Column) -> Column:
        """The variant of a benchmark that a result row was made on, by the bench's own rules; null without one."""
        out = F.lit(None).cast("string")
        for name, rules in self.bench_variants.items():
            out = F.when(bench == name, first_rule(rules, F.lit(None).cast("string"))).otherwise(out)
        return out

    def table_paradigm(self) -> Column:
        """The group that a result is listed in: by rules on its row, else its paper's paradigm."""
        return first_rule(self.table_paradigms, F.col("pd"))

    def metrics(self, bench: Column, m: Column) -> Column:
        """A row's metrics under their usual names, renamed where the usual one is absent."""
        from paperloom.operators.board import rename_metrics

        out = m
        for name, pairs in self.metric_aliases.items():
            out = F.when(bench == name, rename_metrics(m, pairs)).otherwise(out)
        return out

    def protocol(self, bench: Column, said: Column) -> Column:
        """A subset that several papers share, if the verdict names one that the domain knows."""
        out = F.lit(None).cast("string")
        for name, known in self.protocols.items():
            out = F.when((bench == name) & said.isin(*known), said).otherwise(out)
        return out

    def display(self, bench: Column) -> Column:
        return with_names(bench, self.bench_display)

    def preset(self, name: str) -> dict[str, list[str]]:
        return {k: list(v) for k, v in self.presets[name].items()}

    def lacks(self) -> list[str]:
        """What a domain has to state before a library can be built."""
        need = {"tasks": self.tasks, "paradigms": self.paradigms, "benchmarks": self.benchmarks, "categories": self.categories}
        return sorted(k for k, v in need.items() if not v) + ([] if "out" in self.scopes else ["scopes"])


def with_names(code: Column, names: dict[str, str]) -> Column:
    """A code's name, the code itself without one."""
    out = code
    for k, v in names.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def decode(rows: DataFrame, column: str, dimension: DataFrame, to: str) -> DataFrame:
    """Adds a code's label; an unknown code is its own label."""
    d = dimension.select(F.col("code").alias("__code"), F.col("label").alias("__label"))
    return rows.join(d, F.col(column) == F.col("__code"), "left").withColumn(to, F.coalesce("__label", column)).drop("__code", "__label")


def decode_all(rows: DataFrame, column: str, labels: dict[str, str], to: str) -> DataFrame:
    """Labels of an array of codes, in the array's order."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return rows.withColumn(to, F.transform(column, lambda c: F.coalesce(F.try_element_at(known, c), c)))
