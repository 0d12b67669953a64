"""Benchmark decontamination by windows of words.

The windows of all benchmark items are a hash set that every task holds, as long as their
number is within a bound; a task turns a text into numbers of benchmark words, hashes all
its windows at once, looks them up and verifies every hit word by word. A larger benchmark
is met by a join on the windows' hashes instead, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, fresh, join_skewed

#: Words of a window; an item of fewer is one window.
SIZE = 10
#: Words, in UTF-8 once A to Z are lower case; a table that leaves them and blanks all else; words as Spark's patterns say it.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PLAIN = bytes(x if x > 127 or chr(x) in "0123456789abcdefghijklmnopqrstuvwxyz" else ord(" ") for x in bytes(range(256)).lower())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark of at most so many different windows, and bytes of them, is broadcast; a larger one is joined.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1 << 19, 1 << 26
#: Slots of the filter that stands before the sorted hashes, in bits of a hash.
FILTER_BITS = 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(words: Column, size: Column | int) -> Column:
    """All runs of ``size`` words, joined by spaces, with the place of their first word (from 0)."""
    n = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, n), " ").alias("window")))


def item_windows(items: DataFrame, size: int = SIZE, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item, window, length`` once each: the windows of every item with a key and a word."""
    rows = items.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("length", F.least(F.size("words"), F.lit(size)))
    return rows.select("item", "length", F.explode(windows_of(F.col("words"), F.col("length"))).alias("w")).select("item", "w.window", "length").distinct()


@dataclass
class HashSet:
    """Different windows by length: sorted hashes, the numbers of their words, and the items of each."""

    vocabulary: dict[bytes, int]
    #: length -> (hashes in order, words of each window, its number)
    lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    items: list[tuple[str, ...]]

    @classmethod
    def of(cls, rows: list[tuple[str, list[str]]]) -> HashSet:
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], int]]] = {}
        for n, (window, _) in enumerate(rows):
            ids = [vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in window.split(" ")]
            by_length.setdefault(len(ids), []).append((ids, n))
        lengths = {}
        for length, own in by_length.items():
            ids, number = np.array([x[0] for x in own], dtype=np.int64), np.array([x[1] for x in own])
            h = _hashes(ids.ravel(), length)[::length]
            order = np.argsort(h, kind="stable")
            lengths[length] = (h[order], ids[order], number[order])
        return cls(vocabulary, lengths, [tuple(x[1]) for x in rows])

    def filters(self) -> dict[int, np.ndarray]:
        out = {}
        for length, (h, _, _) in self.lengths.items():
            out[length] = np.zeros(1 << FILTER_BITS, dtype=bool)
            out[length][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return out


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every run of ``length`` numbers, longer runs made of shorter ones."""
    with np.errstate(over="ignore"):
        one, size, out, have = ids.astype(np.uint64), 1, None, 0
        while True:
            if length & size:
                # what there is stands before the next ``size`` numbers
                out = one if out is None else out[: len(out) - size] * _power(size) + one[have : have + len(out) - size]
                have += size
            size *= 2
            if size > length:
                out = out[: max(0, len(ids) - length + 1)] * _FACTOR
                return out ^ (out >> np.uint64(31))
            one = one[: -(size // 2)] * _power(size // 2) + one[size // 2 :]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), n, 1 << 64))


def find(ids: np.ndarray, known: HashSet, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of a text lie inside a known window, and place and number of every window it holds.

    ``ids`` are the vocabulary's numbers of the text's words, 0 for all others. The texts
    of a batch may stand in one row with a 0 between them.
    """
    cover, places, found = np.zeros(len(ids) + 1, dtype=np.int64), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    strange = np.concatenate(([0], np.cumsum(ids == 0)))
    for length, (hashes, words, number) in known.lengths.items():
        if len(ids) < length:
            continue
        # windows without a strange word, then those whose hash may be known, then those whose hash is
        at = np.flatnonzero(strange[length:] == strange[:-length])
        h = _hashes(ids, length)[at]
        may = filters[length][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        at, h = at[may], h[may]
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        times = high - low  # windows of one hash, mostly one
        at, first = np.repeat(at, times), np.repeat(low, times)
        nth = first + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
        same = (ids[at[:, None] + np.arange(length)] == words[nth]).all(axis=1)
        at, nth = at[same], nth[same]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        places.append(at)
        found.append(number[nth])
    return np.cumsum(cover)[:-1] > 0, np.concatenate(places), np.concatenate(found)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of hit words."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _scan(known, spans: bool):
    """Words, hit words, items and (if asked for) hit spans of every text, given as bytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own: HashSet = known.value
        filters, number = own.filters(), own.vocabulary.get
        for s in batches:
            texts = [t or b"" for t in s]
            words = [[*t.translate(_PLAIN).split(), b""] for t in texts]  # a word that is none ends each text
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            ends = np.cumsum(sizes)
            ids = np.fromiter(map(number, chain.from_iterable(words), repeat(0)), dtype=np.int64, count=int(sizes.sum()))
            hit, at, windows = find(ids, own, filters)
            of: dict[int, set[str]] = {}
            for doc, w in set(zip(np.searchsorted(ends, at, "right").tolist(), windows.tolist())):
                of.setdefault(doc, set()).update(own.items[w])
            rows = [(int(n) - 1, int(hit[e - n : e].sum()), sorted(of.get(i, ())), _spans(texts[i].lower(), hit[e - n : e - 1]) if spans and i in of else []) for i, (n, e) in enumerate(zip(sizes, ends))]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return F.pandas_udf(run, FOUND)


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code points from the first to the last word of every run of hit words, end exclusive."""
    begins, ends = np.array([(m.start(), m.end()) for m in _WORD.finditer(text)]).T
    # a code point begins at every byte that continues none
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    first, last = _runs(hit)
    return [{"start": int(a), "end": int(b)} for a, b in zip(before[begins[first]], before[ends[last]])]


def scan(docs: DataFrame, items: DataFrame, text: str = "text", size: int = SIZE, item: str = "item_id", item_text: str = "text", windows: int = BROADCAST_WINDOWS, spans: bool = False) -> DataFrame:
    """Columns of ``docs`` and ``n_words, n_hit, items, spans``.

    ``items`` are the keys, as sorted strings, of the items with a window in the text,
    ``spans`` (only if asked for, else empty) the code points from first to last word of each run of hit
    words. A null or empty text has no words and no hits; an item without key or words is
    none. Rows of one item key are one item with the windows of all; repeated documents
    share their fate. A text of any length is scanned whole. Without documents or items
    there is nothing to hit. Columns of ``docs`` that have the new names are replaced.

    Up to ``windows`` different windows of ``BROADCAST_BYTES`` bytes are broadcast; what is more
    is joined by hash, verified by the window itself.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    known = cut(item_windows(items, size, item, item_text).groupBy("window", "length").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    most = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x))), F.lit(0))).first()
    if most[0] > windows or most[1] > BROADCAST_BYTES:
        return _scan_by_join(docs, known, own, text)
    held = docs.sparkSession.sparkContext.broadcast(HashSet.of([(r["window"], r["items"]) for r in known.orderBy("window").collect()]))
    (found,) = fresh(own, "found")
    out = docs.select(*own, _scan(held, spans)(F.col(text).cast("binary")).alias(found))
    return out.select(*own, *(F.col(f"{found}.{c}").alias(c) for c in ("n_words", "n_hit", "items", "spans")))


def _scan_by_join(docs: DataFrame, known: DataFrame, own: list[str], text: str) -> DataFrame:
    """The same for any number of windows: hashes of all windows of the documents meet those of the items.

    A hash travels with a row's number and a place; only what it finds goes back to the
    text to be verified. Frequent windows are dealt over many tasks.
    """
    row, kept = fresh([*own, text], "row", "kept")
    rows = cut(docs.select(F.struct(*own).alias(kept), words_of(F.col(text)).alias("words"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(row, F.monotonically_increasing_id()), "texts")
    lengths = [r[0] for r in known.select("length").distinct().collect()]  # at most as many as a window has words
    hashed = known.groupBy(F.xxhash64("length", "window").alias("h")).agg(F.collect_list(F.struct("window", "length", "items")).alias("may"))
    places = None
    for n in lengths:
        some = rows.select(row, F.explode(windows_of(F.col("words"), n)).alias("w")).select(row, F.col("w.at").alias("at"), F.xxhash64(F.lit(n), F.col("w.window")).alias("h"))
        places = some if places is None else places.union(some)
    met = join_skewed(cut(places, "places"), hashed, "h").select(row, "at", F.explode("may").alias("m"))
    met = met.join(rows.select(row, "words"), row).where(F.array_join(F.slice("words", F.col("at") + 1, F.col("m.length")), " ") == F.col("m.window"))
    hits = met.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("m.items")))).alias("items"), F.collect_set(F.struct("at", F.col("m.length").alias("length"))).alias("places"))

    @F.pandas_udf("n_hit long, spans array<struct<start:int,end:int>>")
    def covered(places: pd.Series, words: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for p, n, t in zip(places, words, text):
            hit = np.zeros(n, dtype=bool)
            for x in p if p is not None else ():
                hit[x["at"] : x["at"] + x["length"]] = True
            out.append((int(hit.sum()), _spans(t.lower(), hit) if hit.any() else []))
        return pd.DataFrame(out, columns=["n_hit", "spans"])

    both = rows.join(hits, row, "left").withColumn("c", covered("places", F.size("words"), F.col("text").cast("binary")))
    return both.select(*(F.col(kept)[c].alias(c) for c in own), F.size("words").cast("long").alias("n_words"), F.col("c.n_hit").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("c.spans").alias("spans"))


def drop_documents(docs: DataFrame, items: DataFrame, text: str = "text", most: float = 0.0, **how) -> DataFrame:
    """Rows of ``docs`` of whose words at most the share ``most`` is hit, with their own columns.

    Texts without words stay. The rest is as in ``scan``.
    """
    (kept,) = fresh([text], "kept")
    found = scan(docs.select(F.struct(*docs.columns).alias(kept), F.col(text)), items, text, **how)
    return found.where(F.col("n_hit") <= F.col("n_words") * F.lit(most)).select(*(F.col(kept)[c].alias(c) for c in docs.columns))


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """All rows of ``docs``, with every hit span cut out of the text; the rest of a text stays as it is.

    A null text stays null. What stands between the words of a span goes with it.
    """
    (kept,) = fresh([text], "kept")
    found = scan(docs.select(F.struct(*docs.columns).alias(kept), F.col(text)), items, text, spans=True, **how)
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text)))
    left = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col(text), a + 1, b - a)), "")
    left = F.when(F.col("n_hit") > 0, left).otherwise(F.col(text))
    return found.withColumn(text, left).select(*(F.col(text) if c == text else F.col(kept)[c].alias(c) for c in docs.columns))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of query op11."""
    found = scan(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{WORD}') AS words FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(words), {SIZE}) AS n, array_to_string(list_slice(words, s, s + least(len(words), {SIZE}) - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - least(len(words), {SIZE}) + 2)) AS s FROM i WHERE len(words) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{WORD}'), []) AS words FROM documents),
w AS (SELECT r, n, s, array_to_string(list_slice(words, s, s + n - 1), ' ') AS win
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM k) WHERE len(words) >= n)),
m AS (SELECT r, s, n, item_id FROM w JOIN k USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS v FROM m) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
