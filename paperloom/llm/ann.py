"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional word from each codebook. Codebooks are learned
one after another from what the ones before leave of a bounded sample; every row is then
encoded by a beam search. The index holds a row's codes and the squared norm of their sum,
so the distance to a query needs one table look-up a codebook. The best of these are
ranked anew by exact distances of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.vectors import matrix, usable

CODEBOOKS, WORDS, BEAM = 32, 256, 4
#: Vectors that the codebooks are learned from.
SAMPLE = 16_384
#: Answers by look-up that are ranked by exact distance, for each query.
SHORTLIST = 200
#: Queries and rows that one group holds, on average: the index is shuffled once for so many queries, each query once for so many rows.
QUERIES, ROWS = 16_384, 65_536
#: Widths that have codebooks, the most frequent ones; rows of any other width are compared as they are.
WIDTHS = 8


def learn(sample: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 8) -> np.ndarray:
    """Codebooks (codebook x word x dimension), each by k-means on the residuals."""
    rest, out, rng = sample.astype(np.float32), [], np.random.default_rng(7)
    words = min(words, len(sample))
    for _ in range(codebooks):
        book = rest[np.sort(rng.choice(len(rest), words, replace=False))].copy()
        for _ in range(rounds):
            near = (-2 * rest @ book.T + (book**2).sum(axis=1)).argmin(axis=1)
            size = np.bincount(near, minlength=words)
            some = np.flatnonzero(size)
            book[some] = np.add.reduceat(rest[np.argsort(near, kind="stable")], (np.cumsum(size) - size)[some], axis=0) / size[some, None]
        near = (-2 * rest @ book.T + (book**2).sum(axis=1)).argmin(axis=1)
        rest = rest - book[near]
        out.append(book)
    return np.stack(out)


def learned(rows: DataFrame, vector: str, sample_rows: int, codebooks: int) -> np.ndarray:
    """Codebooks from the ``sample_rows`` rows of the smallest hashes, learned by an executor; the driver gets the books alone."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = [matrix(pdf["v"], np.float64) for pdf in batches if len(pdf)]
        if sample:
            books = learn(np.concatenate(sample), codebooks)
            yield pd.DataFrame({"books": [books.tobytes()], "words": [books.shape[1]], "width": [books.shape[2]]})

    order = (F.xxhash64(F.lit("codebooks"), F.col(vector)), F.col(vector))
    found = rows.select(F.col(vector).alias("v")).orderBy(*order).limit(sample_rows).coalesce(1).mapInPandas(fit, "books binary, words int, width int").first()
    return np.frombuffer(found["books"], dtype=np.float32).reshape(-1, found["words"], found["width"])


def encode(rows: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row x codebook) and squared norms of the sums they stand for."""
    rows = rows.astype(np.float32)
    n, words = len(rows), books.shape[1]
    rest, codes = rows[:, None], np.zeros((n, 1, 0), dtype=np.uint8)
    for book in books:
        width = rest.shape[1]
        # what is left after each word: |r|^2 - 2 r.c + |c|^2, for every path of the beam
        left = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(n * width, -1) @ book.T).reshape(n, width, words) + (book**2).sum(axis=1)
        left = left.reshape(n, -1)
        keep = min(beam, left.shape[1])
        best = np.argpartition(left, keep - 1, axis=1)[:, :keep]
        path, word = best // words, best % words
        rest = np.take_along_axis(rest, path[:, :, None], axis=1) - book[word]
        codes = np.concatenate((np.take_along_axis(codes, path[:, :, None], axis=1), word[:, :, None].astype(np.uint8)), axis=2)
    best = (rest**2).sum(axis=2).argmin(axis=1)
    codes = codes[np.arange(n), best]
    found = rows - rest[np.arange(n), best]
    return codes, (found.astype(np.float64) ** 2).sum(axis=1)


def lookup(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances less the query's own norm, from a table of products a codebook."""
    tables = np.einsum("qd,mkd->mqk", queries.astype(np.float32), books, optimize=True)
    out = np.zeros((len(queries), len(codes)), dtype=np.float32)
    for m in range(len(books)):
        out += tables[m][:, codes[:, m]]
    return norms[None].astype(np.float32) - 2 * out


def _near(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray | None) -> np.ndarray:
    """As ``lookup``; without codebooks the codes are the rows themselves."""
    return lookup(queries, codes, norms, books) if books is not None else norms[None] - 2 * queries @ codes.T


def search(rows: DataFrame, k: int, every: int, key: str = "vec_id", vector: str = "embedding", shortlist: int = SHORTLIST, codebooks: int = CODEBOOKS, beam: int = BEAM, sample_rows: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for keys divisible by ``every``.

    Null, empty or zero vectors, those with null or non-finite components and rows without a
    key take no part. Every other row is indexed. Only vectors of one width have a
    distance, so each width is a search of its own: the ``WIDTHS`` most frequent ones have
    codebooks of their own, rows of others are compared exactly, each with all of its width in lots. Of rows with one vector only the k + 1 of the smallest keys can
    be answers, so the others are left out of a shortlist, and with fewer rows than
    the shortlist is long the answer is exact. Rows that repeat a key count as often
    as they occur as answers and once as queries. No rows give no rows.
    """
    nonzero = F.exists(F.col(vector).cast("array<double>"), lambda x: x != 0)
    rows = rows.where(usable(F.col(vector)) & nonzero & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut(rows, "vectors")
    widths = [r[0] for r in rows.groupBy(F.size("v")).count().orderBy(F.col("count").desc(), F.size("v")).limit(WIDTHS).collect()]
    books = {w: learned(rows.where(F.size("v") == w), "v", sample_rows, codebooks) for w in widths}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Codes of every row; rows of a width without codebooks keep their components."""
        for pdf in batches:
            for w, own in pdf.groupby(pdf["v"].map(len)) if len(pdf) else ():
                for at in range(0, len(own), 2048):
                    some = own.iloc[at : at + 2048]
                    x = matrix(some["v"], np.float64)
                    codes, norms = encode(x, books[w], beam) if w in books else (x, (x**2).sum(axis=1))
                    yield pd.DataFrame({"id": some["id"].to_numpy(), "width": w, "codes": [c.tobytes() for c in codes], "norm": norms, "same": some["same"].to_numpy()})

    index = cut(rows.withColumn("same", F.xxhash64("v")).mapInPandas(coded, "id long, width int, codes binary, norm double, same long"), "index")
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    count, queries = index.count(), asked.count()
    parts, groups = max(1, -(-count // ROWS)), max(1, -(-queries // QUERIES))
    lot = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asked.select("id", "v", F.size("v").alias("width"), lot(groups, "q").alias("q"), every_one(parts).alias("d"))
    offers = index.select("id", "width", "codes", "norm", "same", every_one(groups).alias("q"), lot(parts, "d").alias("d"))

    def shortlists(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        b = b.sort_values("id", kind="stable")
        b = b[b.groupby("same").cumcount() <= k]
        if len(a) and len(b):
            w = int(b["width"].iloc[0])
            codes = np.frombuffer(b"".join(b["codes"]), dtype=np.uint8 if w in books else np.float64).reshape(len(b), -1)
            ids, norms, same = b["id"].to_numpy(), b["norm"].to_numpy(), b["same"].to_numpy()
            near = matrix(a["v"], np.float64)
            m = min(len(b), shortlist + 1)  # one more, as the query's own row may be among them
            for at in range(0, len(a), 32):
                for q, s in zip(a["id"].iloc[at : at + 32], _near(near[at : at + 32], codes, norms, books.get(w))):
                    best = np.flatnonzero(s <= np.partition(s, m - 1)[m - 1])
                    best = best[np.argsort(s[best], kind="stable")][:m]
                    best = best[ids[best] != q]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[best], "same": same[best], "near": s[best].astype(np.float64)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "same": [], "near": []}).astype({"query_id": "int64", "vec_id": "int64", "same": "int64", "near": "float64"})

    by = ("width", "q", "d")
    found = asks.groupBy(*by).cogroup(offers.groupBy(*by)).applyInPandas(shortlists, "query_id long, vec_id long, same long, near double")
    alike = Window.partitionBy("query_id", "same").orderBy("vec_id")
    nearest = Window.partitionBy("query_id").orderBy("near", "vec_id")
    found = found.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k + 1)
    found = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= shortlist).select("query_id", "vec_id").distinct()
    squares = F.zip_with("q", "v", lambda x, y: (x - y) * (x - y))
    exact = found.join(rows.withColumnRenamed("id", "vec_id"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = exact.select("query_id", "vec_id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The rows of query op7."""
    return search(embeddings.select("vec_id", "embedding"), k=10, every=100)
