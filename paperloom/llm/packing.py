"""Packing documents into sequences by lexical retrieval.

Texts are encoded once; the table of ids gives document frequencies and the mean length of
all documents. A document's shard comes from its content: all terms have one random order
in which rare terms tend to come first, and the first of a document's terms leads it, so
documents of one shard share a telling term. A shard has a BM25 inverted index of its
documents with the weights of the whole corpus; a seed takes its best unused neighbours
in their order, and of the first that does not fit as much as fills the window to the last
token. Terms that lead more documents than a shard holds have several shards.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.token_counts import byte_letters

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
#: The id that ends every document.
END = 1
#: Tokens that a shard holds, on average; its index fits into one task's memory.
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
#: Chunks between white space whose ids a worker remembers.
REMEMBERED = 800_000
#: Neighbours that are ranked at once; more are ranked, twice as many each time, until a window is full.
RANKED = 32
#: Tasks that add up the document frequencies, each a number for every id of the vocabulary.
ADDERS = 32

#: White space beyond ASCII, and what only Python's own split takes for it: such texts go another way.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TAIL = ",.!?;:%*#$&"
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


class Ids:
    """Ids of texts, as the vocabulary file's own tokenizer gives them.

    Its pieces never span white space, so the ids of a text are those of its chunks; new
    chunks of many texts are encoded together and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        #: The merges alone, for chunks that are one piece of lower-case letters and need no normaliser.
        self.model = models.BPE(vocab=spec["vocab"], merges=merges, end_of_word_suffix=spec["end_of_word_suffix"], cache_capacity=0)
        #: Ids there are, the added ones among them, and the type that holds them.
        self.words = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = _kind(self.words)
        self.letters = [letter for letter, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        self.forget()

    def forget(self) -> None:
        #: Chunks' numbers; a number says where its ids begin in ``ids`` and how many they are.
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(1 << 20, dtype="<u4"), np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)
        self.used = 0

    def _add(self, chunks: list[str], ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Number chunks whose ids are ``ids`` from ``begin`` on."""
        n = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(chunks) > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(chunks)], self.size[n : n + len(chunks)] = begin + self.used, size
        self.known.update(zip(chunks, range(n, n + len(chunks))))
        self.used += len(ids)

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered chunks in a row, and where each chunk's end."""
        size = self.size[number]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[number] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at], ends

    def _learn(self, chunks: list[str]) -> None:
        """Number chunks that are new."""
        known = self.known
        stems = [c.rstrip(_TAIL) for c in chunks]
        # signs after a letter or digit are a piece of their own
        ended = [(c, s, c[len(s) :]) for c, s in zip(chunks, stems) if s != c and s.isascii() and s.isalnum()]
        split = {c for c, _, _ in ended}
        new = {c for c in chunks if c not in split}
        new.update([s for _, s, _ in ended if s not in known])
        new.update([t for _, _, t in ended if t not in known])
        plain = [w for w in new if w.isalpha() and (w.isascii() or unicodedata.is_normalized("NFC", w)) and w == w.lower()]
        if plain:
            of, letters = self.model.tokenize, self.letters.__getitem__
            found = [[x.id for x in of(w if w.isascii() else "".join(map(letters, w.encode())))] for w in plain]
            size = np.array(list(map(len, found)))
            self._add(plain, np.array(list(chain.from_iterable(found)), dtype="<u4"), np.cumsum(size) - size, size)
            new.difference_update(plain)
        new = list(new)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            sizes = np.array([len(c) for c in some])
            begins = np.cumsum(sizes + 1) - (sizes + 1)
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            at_char = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(ids))
            ends = np.append(np.searchsorted(at_char, begins), len(ids))
            self._add(some, ids, ends[:-1], np.diff(ends))
        ended = [x for x in ended if x[0] not in known]
        if ended:
            halves = np.empty((len(ended), 2), dtype=np.int64)
            halves[:, 0], halves[:, 1] = [known[s] for _, s, _ in ended], [known[t] for _, _, t in ended]
            ids, ends = self._gather(halves.reshape(-1))
            size = self.size[halves].sum(axis=1)
            self._add([c for c, _, _ in ended], ids, ends[1::2] - size, size)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        found = list(map(self.known.get, chunks))
        if None in found:
            at = [i for i, n in enumerate(found) if n is None]
            self._learn([chunks[i] for i in at])
            for i in at:
                found[i] = self.known[chunks[i]]
        return np.array(found, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id; null is empty."""
        if len(self.known) > REMEMBERED:
            self.forget()
        if "" not in self.known:
            self._add([""], np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
        plain = []
        for t in texts:
            t = t or ""
            # the normaliser lower-cases; done here where it cannot make a special string or meet a final sigma
            plain.append(t.lower() if "<|" not in t and "Σ" not in t else t)
        odd = [i for i, t in enumerate(plain) if _ODD.search(t)]
        split = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        of = split.flatten().dictionary_encode()
        tokens, ends = self._gather(self._numbers(of.dictionary.to_pylist())[of.indices.to_numpy()])
        bounds = np.concatenate(([0], ends))[np.asarray(split.offsets)]
        end = np.array([END], dtype="<u4")
        out = [np.concatenate((tokens[a:b], end)) for a, b in zip(bounds[:-1], bounds[1:])]
        for i in odd:
            out[i] = np.concatenate((self._gather(self._numbers([c for c in _SPACE.split(plain[i]) if c]))[0], end))
        return out


_encoders: dict[str, Ids] = {}


def encoder(vocabulary: str) -> Ids:
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders[vocabulary] = Ids(public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


def counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of every different term of every document, in that order."""
    if not docs:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    key = np.repeat(np.arange(len(docs), dtype=np.int64) << 32, [len(d) for d in docs])
    key |= np.concatenate(docs)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf, key = np.diff(np.append(first, len(key))), key[first]
    return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.uint32), tf


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)


def leading_order(idf: np.ndarray) -> np.ndarray:
    """The place of each term: random and fixed, weightier terms first in proportion; the number of terms for weightless ones."""
    u = (_spread(np.arange(len(idf), dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5
    late = np.where(idf > 0, -np.log(u * 2.0**-53) / np.maximum(idf, 1e-300), np.inf)
    place = np.empty(len(idf), dtype=np.int32)
    place[np.argsort(late, kind="stable")] = np.arange(len(idf), dtype=np.int32)
    place[idf <= 0] = len(idf)
    return place


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Index:
    """A BM25 inverted index of documents given as ids; the ids are the terms.

    ``idf`` (of each id) and ``mean`` (length) are of the whole corpus, without them of
    ``docs``. A term in more than half of the documents has no weight, as its inverse
    document frequency is not positive, and no postings.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        n = self.n = len(docs)
        sizes = np.array([len(d) for d in docs])
        doc, term, tf = counts(docs)
        if idf is None:
            idf = inverse_frequencies(np.bincount(term, minlength=1), n)
        heavy = idf[term] > 0
        doc, term, tf = doc[heavy], term[heavy], tf[heavy]
        # 16 bits, where they hold all terms, are sorted by radix
        order = np.argsort(term.astype(np.uint16) if len(idf) <= 1 << 16 else term, kind="stable")
        sorted_ = term[order]
        start = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(term) else np.zeros(0, dtype=np.int64)
        self.start, self.df = start, np.diff(np.append(start, len(sorted_)))
        self.doc, tf = doc[order].astype(np.int64), tf[order]
        self.weight = idf[sorted_] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / (mean or sizes.mean())))
        # the terms of each document, to ask with
        number = np.zeros(len(idf), dtype=np.int32)
        number[sorted_[start]] = np.arange(len(start), dtype=np.int32)
        self.terms = number[term]
        self.ends = np.cumsum(np.bincount(doc, minlength=n))

    def forget(self, unused: np.ndarray) -> None:
        """Leave used documents out of the postings: they are no neighbours any more."""
        kept = unused[self.doc]
        until = np.concatenate(([0], np.cumsum(kept)))
        begin, end = until[self.start], until[self.start + self.df]
        self.start, self.df, self.doc, self.weight = begin, end - begin, self.doc[kept], self.weight[kept]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the distinct terms of document ``seed``."""
        at = self.terms[self.ends[seed - 1] if seed else 0 : self.ends[seed]]
        size = self.df[at]
        ends = np.cumsum(size)
        if not len(at) or not ends[-1]:
            return np.zeros(self.n)
        from_ = np.repeat(self.start[at] - (ends - size), size)
        from_ += np.arange(len(from_))
        return np.bincount(self.doc[from_], weights=self.weight[from_], minlength=self.n)


def fill(docs: list[np.ndarray], window: int = WINDOW, idf: np.ndarray | None = None, mean: float | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id of ``docs`` once.

    All sequences are full but for the last tokens of all; these are cut into sequences
    whose lengths are powers of two, which need no padding. Equal documents do not start
    in one window as long as there are others.
    """
    if not docs:
        return []
    index, sizes = Index(docs, idf, mean), np.array([len(d) for d in docs])
    same: dict[bytes, int] = {}
    twin = [same.setdefault(d.tobytes(), i) for i, d in enumerate(docs)]
    unused = np.ones(len(docs), dtype=bool)
    postings_for = left = len(docs)
    out: list[list[tuple[int, int, int]]] = []
    open_: list[tuple[int, int, int]] = []
    seed, begin, after = -1, 0, 0
    while True:
        if seed < 0:
            while after < len(docs) and not unused[after]:
                after += 1
            if after == len(docs):
                break
            seed, begin = after, 0
            unused[seed] = False
            left -= 1
        # the seed's whole windows, then what is left of it
        while sizes[seed] - begin >= window:
            out.append([(seed, begin, window)])
            begin += window
        if begin == sizes[seed]:
            seed = -1
            continue
        open_, room, inside = [(seed, begin, int(sizes[seed] - begin))], window - int(sizes[seed] - begin), {twin[seed]}
        if left < 0.7 * postings_for:
            index.forget(unused)
            postings_for = left
        ranked, twins, seed = _ranked(np.where(unused, index.scores(seed), -1.0)), [], -1
        for d, last in chain(((d, False) for d in ranked), _rest(twins)):
            if twin[d] in inside and not last:
                twins.append(d)
                continue
            take = min(room, int(sizes[d]))
            open_.append((d, 0, take))
            unused[d] = False
            left -= 1
            inside.add(twin[d])
            room -= take
            if take < sizes[d]:
                seed, begin = d, take
            if not room:
                break
        if not room:
            out.append(open_)
            open_ = []
    if open_:
        rest = sum(n for _, _, n in open_)
        while rest:
            size, part = 1 << (rest.bit_length() - 1), []
            rest -= size
            while size:
                d, s, n = open_.pop(0)
                take = min(n, size)
                part.append((d, s, take))
                size -= take
                if take < n:
                    open_.insert(0, (d, s + take, n - take))
            out.append(part)
    return out


def _rest(twins: list[int]) -> Iterator[tuple[int, bool]]:
    """What the list holds by the time it is asked for."""
    yield from ((d, True) for d in twins)


def _ranked(score: np.ndarray) -> Iterator[int]:
    """Documents of no negative score by falling score, ties by position: some, then more and more."""
    candidates, some = np.flatnonzero(score >= 0), RANKED
    while len(candidates):
        top, rest = candidates, candidates[:0]
        if len(candidates) > 2 * some:
            own = score[candidates]
            above = own >= np.partition(own, len(own) - some)[len(own) - some]
            top, rest = candidates[above], candidates[~above]
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
        candidates, some = rest, 2 * some


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``with_ids`` adds the ids themselves. A null or empty text is its end id alone.
    Repeated rows are documents of their own, in other windows as long as there are
    other documents. A text of any length is cut into as many windows as it needs. An
    empty table gives an empty table; other columns are left out. Shards are made of
    contents, so a rerun over the same files packs alike.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    kind = dict(docs.select(key).dtypes)[key]

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ids of every text, and at the end of a partition in how many texts each id is."""
        of = encoder(vocabulary)
        df = np.zeros(of.words, dtype=np.int64)
        for pdf in batches:
            ids = of.encode([t if isinstance(t, str) else None for t in pdf["text"]])
            df += np.bincount(counts(ids)[1], minlength=of.words)
            yield pd.DataFrame({"key": pdf["key"], "ids": [x.astype(of.kind).tobytes() for x in ids], "df": None, "n": [len(x) for x in ids]})
        of.forget()
        yield pd.DataFrame({"key": [None], "ids": [None], "df": [df.tobytes()], "n": [0]})

    # the table is written, so the numbers that deal the documents of a hot term are fixed
    encoded = cut(rows.mapInPandas(tokenise, "key string, ids binary, df binary, n int").withColumn("deal", F.monotonically_increasing_id()), "ids")
    found = encoded.where("ids is not null").select("key", "ids", "n", "deal")
    total = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).first()
    if not total["docs"]:
        return encoded.sparkSession.createDataFrame([], _schema(key, kind, with_ids))
    added = encoded.where("df is not null").select("df").coalesce(ADDERS).mapInPandas(_added, "df binary").collect()
    idf = inverse_frequencies(sum(np.frombuffer(r["df"], dtype=np.int64) for r in added), total["docs"])
    place, mean, stored = leading_order(idf), total["tokens"] / total["docs"], _kind(len(idf))

    def led(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tokens of the documents that each term leads, in one partition."""
        tokens = np.zeros(len(place) + 1, dtype=np.int64)
        for pdf in batches:
            np.add.at(tokens, [int(place[np.frombuffer(x, dtype=stored)].min()) for x in pdf["ids"]], pdf["n"].to_numpy())
        at = np.flatnonzero(tokens)
        yield pd.DataFrame({"lead": at, "tokens": tokens[at]})

    sizes = np.zeros(len(place) + 1, dtype=np.int64)
    for r in found.select("ids", "n").mapInPandas(led, "lead int, tokens long").groupBy("lead").agg(F.sum("tokens").alias("tokens")).collect():  # a row for each id at most
        sizes[r["lead"]] = r["tokens"]
    first, parts = shards_of(sizes, shard_tokens)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lead = np.array([int(place[np.frombuffer(x, dtype=stored)].min()) for x in pdf["ids"]], dtype=np.int64)
            lot = _spread(pdf["deal"].to_numpy().astype(np.uint64)) % parts[lead].astype(np.uint64)
            yield pdf.assign(shard=first[lead] + lot.astype(np.int64))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["key", "deal"], kind="stable", na_position="last")
        ids, keys = [np.frombuffer(x, dtype=stored).astype("<u4") for x in pdf["ids"]], pdf["key"].to_numpy()
        out = []
        for n, pieces in enumerate(fill(ids, window, idf, mean)):
            offset = 0
            for d, s, size in pieces:
                part = ids[d][s : s + size]
                out.append((keys[d], s, size, zlib.crc32(part.tobytes()), len(ids[d]), (number << 32) + n, offset, *([part.astype("int32")] if with_ids else [])))
                offset += size
        return pd.DataFrame(out, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    sent = found.mapInPandas(dealt, "key string, ids binary, n int, deal long, shard long").drop("n")
    # the key travels as text, as pandas turns longs with nulls into doubles
    return sent.groupBy("shard").applyInPandas(run, _schema("key", "string", with_ids)).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def _schema(key: str, kind: str, with_ids: bool) -> str:
    return f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids


def _kind(words: int) -> str:
    """The smallest unsigned integers that hold the ids of a vocabulary."""
    return "<u2" if words <= 1 << 16 else "<u4"


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = [sum(np.frombuffer(x, dtype=np.int64) for x in pdf["df"]) for pdf in batches if len(pdf)]
    if found:
        yield pd.DataFrame({"df": [sum(found).tobytes()]})


def shards_of(sizes: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of the documents that each term leads.

    Terms follow one another into shards of about ``shard_tokens`` tokens; one that leads
    more has shards of its own.
    """
    parts = np.maximum(1, -(-sizes // shard_tokens))
    small = np.where(parts == 1, sizes, 0)
    ahead = np.cumsum(small) - small
    shared = ahead // shard_tokens
    own = int(shared.max(initial=0)) + 1 + np.cumsum(np.where(parts > 1, parts, 0)) - parts
    return np.where(parts > 1, own, shared), parts


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op8."""
    return pack(docs.select("doc_id", "text"))
