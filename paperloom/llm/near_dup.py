"""Near-duplicate classes of documents: BagMinHash signatures, bands, exact multiset overlap.

1. Texts that are equal share a node, a hash of the text. Signatures are made of nodes.
2. Nodes with a band in common meet in a bucket. Each is first compared with one chosen
   member of the bucket, so a bucket of any size makes as many pairs as members.
3. Classes found so far are connected components. Only buckets that hold members of two
   or more of them are looked at again, in blocks of bounded size: there every pair of
   nodes whose classes differ is compared, and a found link joins the two classes at once.
   A bucket's largest class meets only the others, never itself, so a bucket of a million
   copies and a few strangers makes as many copies of a member as there are blocks of
   strangers.
A link is a similarity of at least 0.8 over the multisets of five-word shingles, always
computed from the whole texts. A candidate's multiset is computed once and travels as
sorted 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import bagminhash
from paperloom.llm.common import WORD, cut, fresh, join_skewed
from paperloom.llm.components import components

SIMILARITY = 0.8
#: Members of a bucket that one block holds; a task compares two blocks at a time.
BLOCK = 256


def node_of(text: Column) -> Column:
    """The node of a text: its 64-bit hash; null for a text without words."""
    return F.when(text.rlike(WORD), F.xxhash64(text))


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        first = ~pdf["node"].duplicated() & pdf["known"]
        keys: list = [None] * len(pdf)
        at = np.flatnonzero(first)
        if len(at):
            found, _ = bagminhash.signatures(pdf["text"].iloc[at].tolist())
            for i, row in zip(at, bagminhash.bands(found)):
                keys[i] = row
        yield pd.DataFrame({"key": pdf["key"], "node": pdf["node"], "known": pdf["known"], "bands": keys})
    bagminhash.forget()


def _multisets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "items": [bagminhash.multiset(t).tobytes() for t in pdf["text"]]})
    bagminhash.forget()


def _items(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _verified(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = [bagminhash.similarity(_items(a), _items(b)) >= least for a, b in zip(pdf["items"], pdf["chosen_items"])]
            yield pdf.loc[hit, ["a", "b"]]

    return run


def _linked(least: float):
    """Links between classes inside each group of rows; groups come sorted, one after another."""

    def link(group: pd.DataFrame) -> list[tuple[int, int]]:
        group = group.drop_duplicates("node").sort_values("node")
        nodes, classes, major = group["node"].to_numpy(), group["component"].to_numpy(), group["major"].to_numpy()
        sets = [_items(x) for x in group["items"]]
        sizes, across = np.array([len(s) for s in sets]), bool(major.any())
        root = {c: c for c in classes}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i in range(1, len(nodes)):
            near = (np.minimum(sizes[:i], sizes[i]) >= least * np.maximum(sizes[:i], sizes[i])) & (classes[:i] != classes[i])
            if across:  # two of the others meet in a group of their own
                near &= major[:i] != major[i]
            for j in np.flatnonzero(near):
                a, b = find(classes[i]), find(classes[j])
                if a != b and bagminhash.similarity(sets[i], sets[j]) >= least:
                    root[a] = b
                    out.append((int(nodes[j]), int(nodes[i])))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[["band", "i", "j"]]
            begin = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            rest = pdf.iloc[begin[-1] :]
            links = [x for s, e in zip(begin[:-1], begin[1:]) if e - s > 1 for x in link(pdf.iloc[s:e])]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
        if rest is not None and len(rest) > 1:
            yield pd.DataFrame(link(rest), columns=["a", "b"]).astype("int64")

    return run


def _classes(docs: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: (key, node) of every row, (node, component), and a row for each class."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("node", node_of(F.col("text")))
    kind = dict(rows.dtypes)["key"]
    # pandas turns longs with nulls into doubles, so there are none on the way
    sent = rows.select(F.col("key").cast("string").alias("key"), "text", F.coalesce("node", F.lit(0)).alias("node"), F.col("node").isNotNull().alias("known"))
    signed = sent.mapInPandas(_banded, "key string, node long, known boolean, bands array<bigint>")
    signed = cut(signed.select(F.col("key").cast(kind).alias("key"), F.when(F.col("known"), F.col("node")).alias("node"), "bands"), "signed")

    banded = signed.where("bands is not null").select("node", F.explode("bands").alias("band"))
    chosen = F.min_by("node", F.xxhash64(F.lit("chosen"), F.col("node")))
    buckets = cut(banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"), chosen.alias("chosen")).where("first <> last").select("band", "chosen"), "buckets")
    members = cut(banded.join(buckets, "band").distinct(), "members")

    candidates = members.select("node").distinct()
    # one text of each node first: a partition then sends one copy of a text, however many it has
    texts = rows.where("node is not null").groupBy("node").agg(F.first("text").alias("text")).join(candidates, "node", "left_semi")
    items = cut(texts.mapInPandas(_multisets, "node long, items binary"), "items")
    pairs = members.where("node <> chosen").select("node", "chosen").distinct()
    pairs = cut(pairs.groupBy(F.least("node", "chosen").alias("a"), F.greatest("node", "chosen").alias("b")).agg(F.min("node").alias("node"), F.min_by("chosen", "node").alias("chosen")), "pairs")
    both = join_skewed(pairs, items.select(F.col("node").alias("chosen"), F.col("items").alias("chosen_items")), "chosen").join(items, "node")
    links = cut(both.select("a", "b", "items", "chosen_items").mapInPandas(_verified(least), "a long, b long"), "links")

    labels = components(links)
    members = members.select("band", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = cut(members, "members")
    each = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max_by("component", F.struct("n", "component"))
    open_ = each.groupBy("band").agg(largest.alias("largest"), F.max("n").alias("n"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    open_ = cut(open_.select("band", "largest", F.ceil(F.col("n") / BLOCK).cast("int").alias("major_blocks"), F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks")), "open")
    rest = join_skewed(members, open_, "band").withColumn("major", F.col("component") == F.col("largest"))
    own = lambda n: F.pmod(F.xxhash64(F.lit("block"), F.col("node")), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # blocks of the largest class have numbers below 0, so groups (i, j) with i < 0 hold it and one block of others
    spots = F.when(F.col("major"), F.transform(upto("blocks"), lambda j: F.struct((-1 - own("major_blocks")).alias("i"), j.alias("j")))).otherwise(
        F.concat(
            F.transform(upto("major_blocks"), lambda i: F.struct((-1 - i).alias("i"), own("blocks").alias("j"))),
            F.transform(upto("blocks"), lambda o: F.struct(F.least(own("blocks"), o).alias("i"), F.greatest(own("blocks"), o).alias("j"))),
        )
    )
    rest = rest.select("band", "node", "component", "major", F.explode(spots).alias("x")).select("band", "x.i", "x.j", "node", "component", "major")
    more = rest.join(items, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(_linked(least), "a long, b long")
    more = cut(more, "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    nodes = signed.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    classes = nodes.groupBy("component").agg(F.min("key").alias("class_id"), F.sum("n").alias("class_size"), F.min_by("node", F.struct(F.col("key").isNull().alias("none"), "key", "node")).alias("class_node"))
    return signed.select("key", "node"), nodes.select("node", "component"), cut(classes, "classes")


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``key, node, class_id, class_size, class_node``: one row for each row of ``docs``.

    A class is a connected component of links. ``class_id`` is its smallest key,
    ``class_node`` the smallest text hash among the rows with that key. Rows without
    words, null texts among them, are classes of their own with null nodes. Texts of
    fewer than five words are one shingle. Rows that repeat a key are rows of their own;
    null keys are ignored by the minimum. Texts that differ share a node with a
    probability of 2 to the power -64 a pair. An empty table gives an empty table; other
    columns are left out.
    """
    signed, nodes, classes = _classes(docs, key, text, least)
    named = cut(join_skewed(nodes, classes, "component").select("node", "class_id", "class_size", "class_node"), "named")
    out = join_skewed(signed, named, "node", "left")
    alone = F.col("node").isNull()
    return out.select("key", "node", F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), "class_node")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without copies: of each class the row with the smallest key.

    Rows without words all stay, repeated rows stay once. Rows meet the one key and node
    that their class keeps, so a group of copies is spread by its keys. All columns of
    ``docs`` come back, whatever their names.
    """
    _, _, classes = _classes(docs, key, text, least)
    node, keep, keep_node = fresh(docs.columns, "node", "keep", "keep_node")
    kept = classes.select(F.col("class_id").alias(keep), F.col("class_node").alias(keep_node))
    rows = docs.withColumn(node, node_of(F.col(text)))
    found = rows.where(F.col(node).isNotNull()).join(kept, (F.col(node) == F.col(keep_node)) & F.col(key).eqNullSafe(F.col(keep)), "left_semi").dropDuplicates([key, node])
    return found.select(*docs.columns).union(rows.where(F.col(node).isNull()).select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op1: each document and its class."""
    return classify(docs.select("doc_id", "text")).select(F.col("key").alias("doc_id"), "class_id", "class_size", (F.col("class_size") > 1).alias("has_copies"))
