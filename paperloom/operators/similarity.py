"""Joins of alike strings, exact for the Ratcliff-Obershelp ratio.

The ratio of two strings is twice the characters in their common blocks, M, over both
lengths. With u = la + lb - 2M characters outside, there are u + 1 blocks at most, as two
blocks in a row have such a character between them; a block of m characters holds
m - q + 1 grams of q characters. So alike strings share at least
M - (u + 1)(q - 1) grams, which a least ratio and the lengths bound from below by t. Of two sets
that share t elements, the first size - t + 1 in any one order have one in common: with rare grams
first, only strings that meet in a rare gram are compared at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import title_ratio

#: Characters of a gram.
GRAM = 3
#: Strings of one side that one task compares for one key; more are dealt over several.
LOT = 4096
#: Right strings of a key up to which each left one meets them all: a bounded pair costs far less than a gram's row, and no disk.
FEW = 1024
#: What a rounded product of lengths and ratios may be off by.
_EPS = 1e-6


def grams(text: Column, q: int = GRAM) -> Column:
    found = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q))
    return F.when(F.length(text) >= q, found).otherwise(F.array().cast("array<string>"))


def shared_grams(lengths, ratio: float, q: int = GRAM):
    """Grams that two strings share if they are at least ``ratio`` alike and have so many characters together."""
    return lengths * (ratio / 2 - (1 - ratio) * (q - 1)) - (q - 1) - _EPS


_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(text: Column) -> Column:
    """How often each character of a normalised title occurs, and all others together; what two strings have in common bounds their ratio."""
    count = lambda x: F.coalesce(x, F.lit(0))
    known = [count(F.length(text) - F.length(F.replace(text, F.lit(c)))).alias(f"n{i}") for i, c in enumerate(_SIGNS)]
    return F.struct(*known, count(F.length(F.translate(text, _SIGNS, ""))).alias("other"))


def common_letters(a: Column, b: Column) -> Column:
    return reduce(Column.__add__, (F.least(a[c], b[c]) for c in (*(f"n{i}" for i in range(len(_SIGNS))), "other")))


def candidates(left: DataFrame, right: DataFrame, ratio: float, by: tuple[str, ...] = (), q: int = GRAM, lot: int = LOT) -> DataFrame:
    """``a, b`` (ids): pairs of strings that can be at least ``ratio`` alike, each once.

    Both sides have ``id, text`` and the columns ``by``, which have to be equal; a side may
    have an id several times with different ``by``. Strings of one length class meet by the rare grams
    of their prefixes, and places in a string bound each other, too. Of a
    frequent key each ``lot`` strings of the right side are a task's.
    """
    if ratio / 2 <= (1 - ratio) * (q - 1):
        raise ValueError(f"grams of {q} characters bound no ratio of {ratio}")
    of = lambda df: df.select(*by, "id", "text", F.length("text").alias("n")).where("n > 0").distinct()
    left, right = of(left), of(right)
    # at most as many grams as the alphabet gives; how many strings of the right side have each orders them
    seen = right.select("id", F.explode(F.array_distinct(grams(F.col("text"), q))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    step = F.lit((2 - ratio) / ratio)  # alike strings' lengths are within this factor
    class_of = lambda n: F.floor(F.log(n) / F.log(step * (1 + _EPS))).cast("int")

    def prefixes(df: DataFrame) -> DataFrame:
        """The rarest grams of each string: as many as hold one of those that it shares with any string alike to it."""
        least = F.col("n") + F.greatest(F.lit(1.0), F.ceil(F.col("n") / step - _EPS))
        sized = df.withColumn("t", F.ceil(shared_grams(least, ratio, q))).where("t >= 1").withColumn("prefix", (F.col("n") - (q - 1) - F.col("t") + 1).cast("int"))
        each = sized.select(*by, "id", "n", "prefix", F.explode(grams(F.col("text"), q)).alias("gram")).join(seen, "gram", "left")
        counted = each.groupBy(*by, "id", "n", "prefix").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))  # one string's grams
        # equal grams of a string are told apart by how many stand before them
        names = F.transform("g", lambda x: x["gram"])
        nth = F.transform("g", lambda x, i: F.struct(x["gram"].alias("gram"), (i + 1 - F.array_position(names, x["gram"])).cast("int").alias("nth")))
        return counted.select(*by, "id", "n", F.explode(F.slice(nth, F.lit(1), F.col("prefix"))).alias("g")).select(*by, "id", "n", "g.gram", "g.nth")

    # strings too short for a prefix meet all that can be alike to them by their length class
    reach = _short_reach(ratio, q)
    short = lambda df: df.where(F.col("n") <= reach).select(*by, "id", "n", F.lit("").alias("gram"), F.lit(0).alias("nth"))
    a = prefixes(left).unionByName(short(left)).withColumn("class", F.explode(F.array(class_of(F.col("n")) - 1, class_of(F.col("n")), class_of(F.col("n")) + 1)))
    b = prefixes(right).unionByName(short(right)).withColumn("class", class_of(F.col("n")))
    key = [*by, "gram", "nth", "class"]
    lots = b.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / lot).cast("int").alias("lots"))
    b = b.join(lots, key).withColumn("d", F.pmod(F.xxhash64(F.lit("lot"), "id"), F.col("lots")).cast("int")).drop("lots")
    a = a.join(lots, key).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    a, b = (df.select(*key, "d", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "n"))) for df, p in ((a, "a"), (b, "b")))
    could = 2 * F.least("a_n", "b_n") >= (F.col("a_n") + F.col("b_n")) * ratio - _EPS
    return a.join(b, [*key, "d"]).where(could).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def _short_reach(ratio: float, q: int) -> int:
    """The longest string that can be alike to one without a prefix."""
    short = 0
    while True:
        n = short + 1
        least = n + max(1, -(-n * ratio // (2 - ratio)))
        if shared_grams(least, ratio, q) > 0:
            return int(short * (2 - ratio) / ratio)
        short = n


def alike(left: DataFrame, right: DataFrame, ratio: float, by: tuple[str, ...] = (), strictly: bool = False) -> DataFrame:
    """``a, b, ratio`` of all pairs (left id, right id) whose strings are at least ``ratio`` alike, or more if ``strictly``.

    The ratio is that of the right string first, as it depends on the order. An id names one
    string. Letter counts bound it once more before the exact one is computed. Null and empty
    strings are alike to none; equal strings and hot keys are no burden to any one task. With ``by``, keys of at
    most ``FEW`` right strings need no grams: their pairs are made, and bounded, where the strings meet.
    """
    could = 2 * common_letters(F.col("a_letters"), F.col("b_letters")) >= ratio * (F.length("a_text") + F.length("b_text")) - _EPS
    texts = lambda df, p: df.withColumnsRenamed({"id": p, "text": f"{p}_text"}).withColumn(f"{p}_letters", letters(F.col(f"{p}_text")))
    of = lambda df, p: texts(df.select("id", "text").distinct(), p)
    met = None
    if by:
        left, right = (df.select(*by, "id", "text").where("text <> ''").distinct() for df in (left, right))
        sizes = right.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(left.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots")), [*by])
        few, many = sizes.where(F.col("n") <= FEW).select(*by, "lots"), sizes.where(F.col("n") > FEW).select(*by)
        a = texts(left.join(few, [*by]).withColumn("d", F.pmod(F.xxhash64(F.lit("lot"), "id"), F.col("lots")).cast("int")).drop("lots"), "a")
        b = texts(right, "b").join(few, [*by]).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
        met = a.join(b, [*by, "d"]).where(2 * F.least(F.length("a_text"), F.length("b_text")) >= ratio * (F.length("a_text") + F.length("b_text")) - _EPS).where(could).select("a", "b", "a_text", "b_text").distinct()
        left, right = (df.join(many, [*by], "left_semi") for df in (left, right))
    rows = candidates(left, right, ratio, by).join(of(left, "a"), "a").join(of(right, "b"), "b").where(could).select("a", "b", "a_text", "b_text")
    rows = (rows.unionByName(met).distinct() if by else rows).withColumn("ratio", title_ratio("b_text", "a_text"))
    return rows.where(F.col("ratio") > ratio if strictly else F.col("ratio") >= ratio).select("a", "b", "ratio")
