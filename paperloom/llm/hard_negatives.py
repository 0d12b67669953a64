"""Hard negatives by dual-tree search over anchors and candidates.

A tree's node is a ball: a centre, a radius and the range of its labels. Two nodes give an
interval that holds all inner products between their rows, so one comparison with what the
anchors still ask for settles whole groups of anchors at once; pairs of leaves are scored
exactly. The upper levels of the candidates' tree are cells about pivots, which Spark
deals out; anchors, grouped by cell, are sent to the cells that their intervals leave. The
lower levels of both trees are built inside a task, over a bounded lot of rows.

Positives and negatives are the same search. An anchor has asks; an ask wants the k
best rows of its own label, or of others, with a score between two numbers.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.knn import FEWEST, MOST, QUERIES, ROWS, ROWS_A_PIVOT, SAMPLE, SLACK, WIDTHS, Space, exact_products, nearest, pivots_of, place
from paperloom.llm.vectors import matrix, usable

#: Rows of a leaf in either tree.
ANCHOR_LEAF, LEAF = 64, 256
#: Rows found so far that a task holds before it keeps the best of each ask only.
HELD = 1 << 19
_LONG = np.iinfo(np.int64)


@dataclass
class Tree:
    """Rows in the order of a tree, and its nodes; a node without children is a leaf."""

    order: np.ndarray
    begin: list[int]
    end: list[int]
    children: list[tuple[int, int] | None]
    centre: np.ndarray
    radius: np.ndarray
    #: Least and greatest label of a node's rows.
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
        """Rows are split between labels first, then between two rows far apart."""
        order = np.argsort(labels, kind="stable")
        begin, end, children, centre, radius, low, high = [0], [len(rows)], [None], [], [], [], []
        for n in iter(range(1 << 62)):
            if n == len(begin):
                break
            a, b = begin[n], end[n]
            x, own = rows[order[a:b]], labels[order[a:b]]
            centre.append(x.mean(axis=0))
            radius.append(np.sqrt(((x - centre[n]) ** 2).sum(axis=1).max()))
            low.append(own.min()), high.append(own.max())
            # a leaf of several labels is met by the rows of each, so these are parted further
            if b - a <= (leaf if low[n] == high[n] else leaf // 8):
                continue
            if low[n] < high[n]:
                order[a:b] = order[a:b][np.argsort(own, kind="stable")]
                own = labels[order[a:b]]
                edges = np.flatnonzero(own[1:] != own[:-1]) + 1
                middle = a + int(edges[np.abs(edges - (b - a) // 2).argmin()])
            else:
                far = x[((x - centre[n]) ** 2).sum(axis=1).argmax()]
                other = x[((x - far) ** 2).sum(axis=1).argmax()]
                along = x @ (other - far)
                near = int((along < (far + other) @ (other - far) / 2).sum())
                # the nearer of two far rows, unless that leaves one side almost empty
                middle = a + (near if min(near, b - a - near) * 16 >= b - a else (b - a) // 2)
                order[a:b] = order[a:b][np.argpartition(along, middle - a)]
            children[n] = (len(begin), len(begin) + 1)
            begin += [a, middle]
            end += [middle, b]
            children += [None, None]
        return cls(order, begin, end, children, np.array(centre), np.array(radius), np.array(low), np.array(high))


def interval(a: np.ndarray, ra: float, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product between a ball about ``a`` and balls about the rows of ``b``.

    With x = a + e and y = b + d the product is a.b + a.d + e.b + e.d.
    """
    middle = b @ a
    spread = np.sqrt((a**2).sum()) * rb + ra * np.sqrt((b**2).sum(axis=-1)) + ra * rb
    spread = spread + SLACK * (1 + np.abs(middle) + spread)
    return middle - spread, middle + spread


@dataclass
class Asks:
    """Asks in the order of their anchors: whose each is, its number there, and its bounds."""

    anchor: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Asks:
        sizes = pdf["n"].map(len).to_numpy() if len(pdf) else np.zeros(0, dtype=np.int64)
        flat = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf[c]]) if len(pdf) else np.zeros(0, dtype=np.int64)
        return cls(np.repeat(np.arange(len(pdf)), sizes), flat("n"), flat("low"), flat("high"))


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each ask; ties to the smaller key. ``~x`` falls as ``x`` rises and cannot overflow."""
    order = np.lexsort((found["vec_id"], ~found["score"].to_numpy(), found["ask"]))
    found = found.iloc[order]
    return found[found.groupby("ask").cumcount() < k]


def _candidates(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be answers: of equal rows, those of the k + 1 smallest keys, at most k of a key."""
    kind = pd.DataFrame({"row": [r.tobytes() for r in rows], "label": labels, "id": ids}).sort_values(["label", "row", "id"], kind="stable")
    new_key = (~kind.duplicated()).groupby([kind["label"], kind["row"]]).cumsum()
    return np.sort(kind.index[(new_key <= k + 1) & (kind.groupby(["label", "row", "id"]).cumcount() < k)].to_numpy())


def search(ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, asks: Asks, row_ids: np.ndarray, row_labels: np.ndarray, rows: np.ndarray, k: int, same: bool) -> tuple[pd.DataFrame, float]:
    """``ask, vec_id, score`` of the k best rows for every ask, and the share of all pairs that was scored.

    An ask takes rows of its anchor's label (``same``) or of other labels, of another
    key, whose score is within its bounds.
    """
    empty = pd.DataFrame({"ask": [], "vec_id": [], "score": []}, dtype="int64")
    keep = _candidates(row_ids, row_labels, rows, k) if len(rows) else np.zeros(0, dtype=np.int64)
    row_ids, row_labels, rows = row_ids[keep], row_labels[keep], rows[keep]
    if not len(asks.n) or not len(rows):
        return empty, 0.0
    left = Tree.of(anchors.astype(np.float64), labels, ANCHOR_LEAF)
    right = Tree.of(rows.astype(np.float64), row_labels, LEAF)
    anchors, ids, labels = anchors[left.order], ids[left.order], labels[left.order]
    rows, row_ids, row_labels = rows[right.order], row_ids[right.order], row_labels[right.order]
    # asks follow their anchors into the tree's order
    place_of = np.empty(len(ids), dtype=np.int64)
    place_of[left.order] = np.arange(len(ids))
    number = np.argsort(place_of[asks.anchor], kind="stable")
    whose, low, high = place_of[asks.anchor][number], asks.low[number], asks.high[number]
    first = np.searchsorted(whose, np.arange(len(ids) + 1))
    best = np.full((len(whose), k), _LONG.min, dtype=np.int64)  # scores, the least one first
    floor = low.copy()  # what a row has to reach: the ask's bound, then its k-th best row so far
    found, held, scored, tried = [], 0, 0, 0
    heap: list[tuple[float, int, int, int, float]] = []

    def offer(a: int, b: int) -> None:
        nonlocal tried
        apart = left.high[a] < right.low[b] or right.high[b] < left.low[a]
        alone = left.low[a] == left.high[a] == right.low[b] == right.high[b]
        if apart if same else alone:
            return
        least, most = interval(left.centre[a], left.radius[a], right.centre[b], right.radius[b])
        tried += 1
        heapq.heappush(heap, (-float(most), tried, a, b, float(least)))

    offer(0, 0)
    while heap:
        most, _, a, b, least = heapq.heappop(heap)
        s = slice(first[left.begin[a]], first[left.end[a]])
        if not ((-most >= floor[s]) & (least <= high[s])).any():
            continue
        one, two = left.children[a], right.children[b]
        if two and (not one or right.radius[b] >= left.radius[a]):
            for c in two:
                offer(a, c)
            continue
        if one:
            for c in one:
                offer(c, b)
            continue
        x, y = slice(left.begin[a], left.end[a]), slice(right.begin[b], right.end[b])
        score = exact_products(anchors[x], rows[y])
        scored += score.size
        fits = (labels[x, None] == row_labels[None, y]) == same
        fits &= ids[x, None] != row_ids[None, y]
        of = whose[s] - left.begin[a]
        score, fits = score[of], fits[of]
        fits &= (score >= floor[s, None]) & (score <= high[s, None])
        some = np.flatnonzero(fits.any(axis=1))
        if not len(some):
            continue
        fits, score, at = fits[some], score[some], s.start + some
        offered = np.where(fits, score, _LONG.min)
        if offered.shape[1] > k:
            offered = np.partition(offered, offered.shape[1] - k, axis=1)[:, offered.shape[1] - k :]
        best[at] = np.sort(np.concatenate((best[at], offered), axis=1), axis=1)[:, -k:]
        floor[at] = np.maximum(floor[at], best[at, 0])
        i, j = np.nonzero(fits & (score >= floor[at, None]))
        found.append(pd.DataFrame({"ask": at[i], "vec_id": row_ids[y][j], "score": score[i, j]}))
        held += len(i)
        if held > HELD:
            found = [_best(pd.concat(found), k)]
            held = len(found[0])
    out = _best(pd.concat(found), k) if found else empty
    return out.assign(ask=number[out["ask"].to_numpy(dtype=np.int64)]), scored / (len(ids) * len(rows))


def _route(spaces: dict[int, Space], labels_of: dict[int, np.ndarray], k: int, same: bool):
    """The cells that each anchor has to be asked in, settled for all anchors of a cell at once."""

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
                s, own = spaces[w], pdf.iloc[at]
                x, asks = matrix(own["v"], np.float64), Asks.of(own)
                floor = _floors(own["id"].to_numpy(), own["label"].to_numpy(), x, asks, s, labels_of[w], k, same)
                near = nearest(x, s.pivots)[0]
                for c in np.unique(near):
                    group = near == c
                    centre = x[group].mean(axis=0)
                    radius = np.sqrt(((x[group] - centre) ** 2).sum(axis=1).max())
                    least, most = interval(centre, radius, s.pivots, np.maximum(s.radius, 0))
                    most = np.minimum(most, np.sqrt((x[group] ** 2).sum(axis=1).max()) * s.norm * (1 + SLACK) + SLACK)
                    mine = group[asks.anchor]
                    wanted = ((most[None] >= floor[mine, None]) & (least[None] <= asks.high[mine, None])).any(axis=0) & (s.radius >= 0)
                    for i in at[group]:
                        cells[i] = s.first + np.flatnonzero(wanted)
            yield pdf.assign(cells=cells)

    return run


def _floors(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, asks: Asks, s: Space, sample_labels: np.ndarray, k: int, same: bool) -> np.ndarray:
    """A score that the k best rows of each ask reach: that of the sample's k-th best row for it."""
    out = asks.low.astype(np.float64)
    for at in range(0, len(asks.n), 256):
        some = slice(at, at + 256)
        who = asks.anchor[some]
        score = x[who] @ s.sample.T
        fits = ((labels[who, None] == sample_labels[None]) == same) & (ids[who, None] != s.sample_ids[None])
        score = np.where(fits & (score >= asks.low[some, None]) & (score <= asks.high[some, None]), score, -np.inf)
        if score.shape[1] >= k:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            out[some] = np.maximum(out[some], np.where(np.isfinite(least), least - SLACK * (1 + np.abs(least)), -np.inf))
    return out


_ROW = "id long, label long, v array<bigint>"


@dataclass
class Candidates:
    """Rows in cells, written, and what is known of the cells: one for each pivot of each frequent width."""

    placed: DataFrame
    parts: DataFrame
    spaces: dict[int, Space]
    labels: dict[int, np.ndarray]

    @classmethod
    def of(cls, rows: DataFrame) -> Candidates:
        total = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().orderBy(F.col("count").desc(), F.size("v")).limit(WIDTHS).collect()}
        order = Window.partitionBy(F.size("v")).orderBy(F.xxhash64(F.lit("pivots"), F.col("v")), "id", "label")
        some = rows.where(F.size("v").isin(*total) if total else F.lit(False)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE).orderBy("nth").select("id", "label", "v").toPandas()
        spaces, labels, first = {}, {}, 0
        for w, n in sorted(total.items()):
            mine = some[some["v"].map(len) == w]
            sample = matrix(mine["v"], np.float64)
            points = pivots_of(sample, min(MOST, max(FEWEST, n // ROWS_A_PIVOT)))
            spaces[w], labels[w] = Space(first, points, mine["id"].to_numpy(), sample, np.full(len(points), -1.0), np.zeros(len(points))), mine["label"].to_numpy()
            first += len(points)
        placed = rows.mapInPandas(place(spaces), f"{_ROW}, cell long, distance double, norm double")
        # lots are dealt here and written, so a hot cell is split alike in every retry
        placed = cut(placed.withColumn("deal", F.xxhash64(F.lit("deal"), F.monotonically_increasing_id())), "cells")
        parts = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.max("norm").alias("norm"), F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
        parts = cut(parts, "summaries")
        for r in parts.where("cell >= 0").collect():  # a row for each pivot
            s = next(s for s in spaces.values() if s.first <= r["cell"] < s.first + len(s.pivots))
            s.radius[r["cell"] - s.first], s.norm[r["cell"] - s.first] = r["radius"], r["norm"]
        return cls(placed, parts.select("cell", "parts"), spaces, labels)

    def best(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """``id, n, rank, vec_id, score`` for rows ``id, label, v`` with arrays ``n, low, high`` of asks."""
        kind = f"{_ROW}, n array<bigint>, low array<bigint>, high array<bigint>"
        blocks = max(1, -(-asked.count() // QUERIES))
        asks = (
            asked.select("id", "label", "v", *(F.col(c).cast("array<bigint>") for c in ("n", "low", "high")))
            .mapInPandas(_route(self.spaces, self.labels, k, same), f"{kind}, cells array<bigint>")
            .select("id", "label", "v", "n", "low", "high", F.explode("cells").alias("cell"))
            .join(self.parts, "cell")
            .withColumn("q", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(blocks)).cast("int"))
            .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        )
        offers = self.placed.join(self.parts, "cell").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("d", F.pmod("deal", F.col("parts")).cast("int")).select("id", "label", "v", "cell", "q", "d")

        def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"id": [], "n": [], "vec_id": [], "score": []}, dtype="int64")
            given = Asks.of(a)
            got, _ = search(a["id"].to_numpy(), a["label"].to_numpy(), matrix(a["v"], np.int64), given, b["id"].to_numpy(), b["label"].to_numpy(), matrix(b["v"], np.int64), k, same)
            ask = got["ask"].to_numpy(dtype=np.int64)
            return pd.DataFrame({"id": a["id"].to_numpy()[given.anchor[ask]], "n": given.n[ask], "vec_id": got["vec_id"].to_numpy(), "score": got["score"].to_numpy()})

        by = ("cell", "q", "d")
        found = asks.groupBy(*by).cogroup(offers.groupBy(*by)).applyInPandas(solve, "id long, n long, vec_id long, score long")
        order = Window.partitionBy("id", "n").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the keys divisible by ``every``; ``vector`` is an array of long. An
    anchor's positives are its ``positives`` best other rows of its label, fewer if
    there are no more; for each, the ``negatives`` best rows of other labels whose score is
    from ``least`` to ``most`` hundredths of the positive's. A negative positive score leaves nothing
    between, and gives no rows. Ties go to the smaller key.

    Rows without key, label or vector and vectors that are empty or hold null take no part;
    only vectors of one width have a product. Of rows that repeat a key each is a
    candidate, none for its own key; as an anchor the key counts once, with the least label
    and vector. A score beyond 64 bits is clipped. An empty table gives no rows. Columns of
    any other name are left out.
    """
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = cut(rows.where("id is not null and label is not null and size(v) > 0 and not exists(v, x -> x is null)"), "vectors")
    among = Candidates.of(rows)
    anchors = cut(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.label", "least.v"), "anchors")
    one = lambda x: F.array(F.lit(x))
    good = among.best(anchors.withColumns({"n": one(0), "low": one(_LONG.min), "high": one(_LONG.max)}), positives, True)
    good = cut(good.select("id", F.col("rank").cast("long").alias("n"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * score within least and most times the positive's, in whole numbers that cannot overflow
    p, hundred = F.col("positive_score"), F.lit(100)
    share = lambda x: F.expr(f"positive_score div 100 * {x}") + F.expr(f"positive_score % 100 * {x} div 100")
    rest = F.when(p % hundred * least % hundred > 0, 1).otherwise(0)
    bounds = good.where(p >= 0).select("id", F.struct("n", (share(least) + rest).alias("low"), share(most).alias("high")).alias("ask"))
    asked = bounds.groupBy("id").agg(F.sort_array(F.collect_list("ask")).alias("ask")).select("id", "ask.n", "ask.low", "ask.high").join(anchors, "id")  # at most ``positives`` asks
    bad = among.best(cut(asked, "asks"), negatives, False)
    return bad.join(good, ["id", "n"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The rows of query op12."""
    whole = embeddings.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("long"))
    return mine(whole.select("vec_id", label.alias("label"), scaled.alias("vector")), every=50)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
