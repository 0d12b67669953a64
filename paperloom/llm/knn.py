"""Exact top-k by integer inner product: a Voronoi join of queries with all rows.

Pivots cut the space into cells. Every data row lies in the cell of its nearest pivot and is
shuffled once. A cell's summary (pivot, radius, greatest norm) bounds the score that any of
its rows can have for a query; a bounded sample of rows gives every query a score that its
k best answers reach at least. Only the queries are replicated, each to the cells whose bound
reaches that score; cells are solved by themselves and the best answers merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.vectors import matrix, usable

#: A pivot for so many rows, within these bounds: more rows have finer cells.
ROWS_A_PIVOT, FEWEST, MOST = 1024, 16, 1024
#: Vectors of one width that pivots are chosen from, and that tell what the best scores reach.
SAMPLE = 4096
#: Widths that have pivots, the most frequent ones; rows of any other width are one cell.
WIDTHS = 8
#: Queries and data vectors that one group holds, on average.
QUERIES, ROWS = 16_384, 16_384
#: A little more than the rounding of a bound.
SLACK = 1e-6
_LONG = np.iinfo(np.int64)


def pivots_of(sample: np.ndarray, number: int) -> np.ndarray:
    """Means of a few rounds of k-means over a bounded sample."""
    number = min(number, len(sample))
    found = sample[:number].copy()
    for _ in range(5):
        near = nearest(sample, found)[0]
        size = np.bincount(near, minlength=number)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(size)
        sums = np.add.reduceat(sample[order], (np.cumsum(size) - size)[some], axis=0)
        found[some] = sums / size[some, None]
    return found


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance of every row."""
    d = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)[None]
    at = d.argmin(axis=1)
    return at, np.sqrt(((rows - pivots[at]) ** 2).sum(axis=1))


def most_scores(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For every query and cell a score that no row of the cell exceeds.

    With x = p + e the product is at most q.p + |q||e|, and never more than |q||x|.
    """
    own = np.sqrt((queries**2).sum(axis=1))[:, None]
    most = np.minimum(queries @ pivots.T + own * radius[None], own * norm[None])
    return most + SLACK * (1 + np.abs(most))


def least_scores(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For every query a score that its k best answers reach: that of the sample's k-th best row of another key."""
    if len(sample) < k:
        return np.full(len(queries), -np.inf)
    out = np.empty(len(queries))
    for at in range(0, len(queries), 256):
        s = queries[at : at + 256] @ sample.T
        s[ids[at : at + 256, None] == sample_ids[None]] = -np.inf
        out[at : at + 256] = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k]
    return np.where(np.isfinite(out), out - SLACK * (1 + np.abs(out)), -np.inf)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, by floating point where every sum is below 2 to the power 53; sums beyond a long are clipped."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LONG.min, _LONG.max).astype(np.int64)


def top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each query, its own key left out; ties to the smaller key."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    asked, found, scored = [], [], []
    for at in range(0, len(queries), 128):
        scores = exact_products(queries[at : at + 128], rows)
        own = ids[None] == query_ids[at : at + 128, None]
        for q, s, same in zip(query_ids[at : at + 128], scores, own):
            m = min(len(s), k + int(np.count_nonzero(same)))
            best = np.flatnonzero(s >= np.partition(s, len(s) - m)[len(s) - m])  # in order of keys, so a stable sort settles ties
            best = best[~same[best]]
            best = _by_score(s, best)[:k]
            asked.append(np.full(len(best), q))
            found.append(ids[best])
            scored.append(s[best])
    join_ = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"query_id": join_(asked), "vec_id": join_(found), "score": join_(scored)}).astype("int64")


def _by_score(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions by falling score, equal ones in their order; ``~x`` falls as ``x`` rises and cannot overflow."""
    return at[np.argsort(~scores[at], kind="stable")]


@dataclass
class Space:
    """What is known of the vectors of one width: cells, their summaries, and the sample."""

    first: int
    pivots: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    radius: np.ndarray
    norm: np.ndarray


def place(spaces: dict[int, Space]):
    """Every row's cell: a number for each pivot, and ``-1 - width`` where the width has no pivots."""

    def run(batches):
        for pdf in batches:
            width = pdf["v"].map(len).to_numpy() if len(pdf) else np.zeros(0, dtype=np.int64)
            cell, distance, norm = -1 - width.astype(np.int64), np.zeros(len(pdf)), np.zeros(len(pdf))
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x = matrix(pdf["v"].iloc[at], np.float64)
                norm[at] = np.sqrt((x**2).sum(axis=1))
                if w in spaces:
                    near, distance[at] = nearest(x, spaces[w].pivots)
                    cell[at] = spaces[w].first + near
            yield pdf.assign(cell=cell, distance=distance, norm=norm)

    return run


def _route(spaces: dict[int, Space], k: int):
    """The cells that each query has to be asked in."""

    def run(batches):
        for pdf in batches:
            cells: list = [None] * len(pdf)
            width = pdf["v"].map(len).to_numpy() if len(pdf) else np.zeros(0, dtype=np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                if w not in spaces:
                    for i in at:
                        cells[i] = np.array([-1 - w], dtype=np.int64)
                    continue
                s, x, ids = spaces[w], matrix(pdf["v"].iloc[at], np.float64), pdf["id"].to_numpy()[at]
                wanted = most_scores(x, s.pivots, s.radius, s.norm) >= least_scores(ids, x, s.sample_ids, s.sample, k)[:, None]
                for i, hit in zip(at, wanted & (s.radius >= 0)[None]):
                    cells[i] = s.first + np.flatnonzero(hit)
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cells": cells})

    return run


def join(rows: DataFrame, k: int, every: int, key: str = "vec_id", vector: str = "vector", pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every key divisible by ``every``.

    ``vector`` is an array of long. A row is no answer to a query of its own key, and
    only vectors of one width have a product, so each width is a search of its own. Rows
    without a key or with null, empty or null-holding vectors take no part; rows that
    repeat a key count as often as they occur as answers and once as queries, with the
    least vector. A score beyond 64 bits is clipped to them. An empty table gives no rows.
    """
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    rows = cut(rows, "vectors")
    total = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().orderBy(F.col("count").desc(), F.size("v")).limit(WIDTHS).collect()}
    order = Window.partitionBy(F.size("v")).orderBy(F.xxhash64(F.lit("pivots"), F.col("v")), "id")
    some = rows.where(F.size("v").isin(*total)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE).orderBy("nth").select("id", "v").toPandas() if total else pd.DataFrame({"id": [], "v": []})
    spaces: dict[int, Space] = {}
    first = 0
    for w, n in sorted(total.items()):
        mine = some[some["v"].map(len) == w]
        sample, number = matrix(mine["v"], np.float64), pivots or min(MOST, max(FEWEST, n // ROWS_A_PIVOT))
        points = pivots_of(sample, number)
        spaces[w] = Space(first, points, mine["id"].to_numpy(), sample, np.full(len(points), -1.0), np.zeros(len(points)))
        first += len(points)

    # lots are dealt here and written, so a hot cell and a key with many rows are split alike in every retry
    placed = rows.mapInPandas(place(spaces), "id long, v array<bigint>, cell long, distance double, norm double")
    placed = cut(placed.withColumn("deal", F.xxhash64(F.lit("deal"), F.monotonically_increasing_id())), "cells")
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm"))
    summary = cut(summary.withColumn("parts", F.ceil(F.col("n") / ROWS).cast("int")), "summaries")
    for r in summary.where("cell >= 0").collect():  # a row for each pivot
        s = next(s for s in spaces.values() if s.first <= r["cell"] < s.first + len(s.pivots))
        s.radius[r["cell"] - s.first], s.norm[r["cell"] - s.first] = r["radius"], r["norm"]

    asked = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERIES))
    parts = summary.select("cell", "parts")
    asks = (
        asked.mapInPandas(_route(spaces, k), "id long, v array<bigint>, cells array<bigint>")
        .select("id", "v", F.explode("cells").alias("cell"))
        .join(parts, "cell")
        .select("id", "v", "cell", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d"))
    )
    offers = (
        placed.join(parts, "cell")
        .select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"), F.pmod("deal", F.col("parts")).cast("int").alias("d"))
    )

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return top(a["id"].to_numpy(), matrix(a["v"], np.int64), b["id"].to_numpy(), matrix(b["v"], np.int64), k)

    by = ("cell", "q", "d")
    found = asks.groupBy(*by).cogroup(offers.groupBy(*by)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The rows of query op5."""
    whole = embeddings.where(usable(F.col("embedding")))
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("long"))
    return join(whole.select("vec_id", scaled.alias("vector")), k=5, every=50)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
