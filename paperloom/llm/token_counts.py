"""Token counts by byte-pair merging on a heap and a linked list.

Texts are cut into pieces; a piece starts as its bytes and loses one symbol with every
merge, so its count is bytes minus merges and no identifiers are made. Every worker keeps
the counts of pieces it has met in a memory of bounded size.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 800_000
#: Texts longer than this are cut at line feeds or spaces first, so that one text's pieces need no large list.
SLICE = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes are their own Latin-1 letter; the others take the letters from U+0100
    on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts as the vocabulary file's own tokenizer would."""

    def __init__(self, path: str, pattern: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left, right) -> rank and what they make
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = to_bytes(a), to_bytes(b)
            self.merges.setdefault((a, b), (rank, a + b))
        self.single = [bytes([b]) for b in range(256)]
        self.split = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece: its bytes minus the merges that the heap yields."""
        data = text.encode("utf-8", "replace")
        n = len(data)
        if n < 2:
            return n
        single, merges = self.single, self.merges
        symbols = [single[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := merges.get((symbols[i], symbols[i + 1])):
                heap.append((hit[0], i, symbols[i], symbols[i + 1], hit[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is not a and symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = made, b""
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if hit := merges.get((made, symbols[k])):
                    heapq.heappush(heap, (hit[0], i, made, symbols[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := merges.get((symbols[h], made))):
                heapq.heappush(heap, (hit[0], h, symbols[h], made, hit[1]))
        return left

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        pieces = self.split.findall(text)
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = self.piece(p)
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def _sliced(self, text: str) -> int:
        """A long text, cut where a letter or digit is followed by one space and a letter: no piece spans that."""
        total, at = 0, 0
        while len(text) - at > SLICE:
            m = _CUT.search(text, at + SLICE // 2)
            if not m:
                break
            total += self._plain(text[at : m.start() + 1])
            at = m.start() + 1
        return total + self._plain(text[at:])

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._sliced(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._sliced, parts))


_CUT = regex.compile(r"[\p{L}] (?=\p{L})")

_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary, made once."""
    import public_tokenizers

    key = (path, public_tokenizers.PATTERN)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text, 0 for null and empty texts; no text is shortened or padded."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(vocabulary_path(vocabulary))
        for s in batches:
            yield pd.Series([of.count(t) if t else 0 for t in s], dtype="int64")

    return counts(text)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = 512, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to every row of ``docs``.

    Row by row and without a shuffle: repeated rows stay, an empty table stays empty,
    columns of these three names are replaced.
    """
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", token_count(F.col(text), vocabulary))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op9."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
