"""Decontamination, hard negatives and the divergence of sources, against plain loops."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, divergence, hard_negatives

# ---- decontamination ---------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOW))


def plain_hits(text, items):
    own, hit, found = words(text), set(), set()
    for key, item in items:
        w = words(item)
        size = min(10, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w and key is not None else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(key))
    return len(own), len(hit), sorted(found)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "x1", "數據", "d", "e"]
    some = lambda n: r.choices(vocabulary, k=n)
    items = [(i, r.choice([" ", ", ", "\n"]).join(some(n))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 25, 11])] + [(20, None), (21, ""), (22, "?!"), (None, "alpha Beta"), (1, " ".join(some(14))), (3, items_ := "alpha d alpha d")]
    docs = []
    for i in range(60):
        parts = some(r.randint(0, 30))
        for _ in range(r.randint(0, 2)):
            own = words(r.choice(items)[1] or "")
            a = r.randint(0, max(0, len(own) - 10))
            parts += [*own[a : a + r.randint(5, 14)], *some(3)]
        docs.append((i, r.choice([" ", "--", "\t"]).join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in parts)))
    docs += [(100, None), (101, ""), (102, "..."), (103, docs[0][1]), (103, docs[0][1]), (None, items_), (104, " ".join(some(20)) + " " + "zz " * 200_000 + items[0][1])]
    return docs, items


@pytest.mark.parametrize("windows", [1 << 19, 3])
def test_hits_are_those_of_a_loop(spark, texts, windows):
    docs, items = texts
    d = spark.createDataFrame([(i, t, 1, [2]) for i, t in docs], "doc_id long, text string, n_hit int, spans array<int>")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(d, b, windows=windows, spans=True).collect()), key=repr)
    want = sorted(((i is None, i, *plain_hits(t, items)) for i, t in docs), key=repr)
    assert got == want and any(x[3] for x in got) and any(not x[3] for x in got)


def test_digest_and_removal(spark, texts):
    docs, items = texts
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.digest(d, b).collect():
        n, hit, found = plain_hits(next(t for i, t in docs if i == r["doc_id"]), items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    only = spark.createDataFrame([(7, "One two three four five six seven eight nine ten eleven.")], "item_id long, text string")
    few = spark.createDataFrame([(1, "Été: one two, three FOUR five six seven eight nine (ten) twelve!", "a"), (2, "one two", "b"), (3, None, "c")], "doc_id long, text string, kept string")
    assert [tuple(r) for r in decontaminate.remove_spans(few, only).orderBy("doc_id").collect()] == [(1, "Été: ) twelve!", "a"), (2, "one two", "b"), (3, None, "c")]
    assert [r["doc_id"] for r in decontaminate.drop_documents(few, only).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.drop_documents(few, only, most=0.95).count() == 3
    assert decontaminate.digest(d.limit(0), b).count() == 0 and {r["n_hit"] for r in decontaminate.digest(d, b.limit(0)).collect()} == {0}


# ---- hard negatives ----------------------------------------------------------------


def plain_negatives(rows, every, positives=5, negatives=3):
    out = []
    for a in sorted({i for i, _, _ in rows if i % every == 0}):
        label, v = min((x[1], x[2]) for x in rows if x[0] == a)
        score = lambda w: sum(p * q for p, q in zip(v, w))  # noqa: E731, B023
        ranked = sorted((-score(w), i, own) for i, own, w in rows if i != a and len(w) == len(v))
        for s, p in [(s, i) for s, i, own in ranked if own == label][:positives]:
            fits = [(t, i) for t, i, own in ranked if own != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_negatives_are_those_of_a_loop(spark, monkeypatch):
    for name, n in {"QUERIES": 9, "ROWS": 100, "FEWEST": 7, "ANCHOR_LEAF": 3, "LEAF": 8, "HELD": 50}.items():
        monkeypatch.setattr(hard_negatives, name, n)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(4)), rng.integers(-20, 60, 8).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(120)]  # one very common vector
    rows += [(7, 2, rows[9][2]), (10, 0, rows[10][2]), (10, 0, rows[10][2])]  # keys that occur again
    rows += [(2000, 5, [1, 2, 3]), (2001, 5, [2, 2, 2]), (2002, 6, [1, 1, 1]), (2010, 9, [1] * 8), (-10, 1, [2] * 8)]
    none = [(3000, None, [1] * 8), (3010, 1, None), (3020, 1, [None] * 8), (None, 1, [1] * 8), (3030, 1, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + none], "vec_id long, label int, vector array<bigint>, score string")
    got = as_rows(hard_negatives.mine(df, every=10))
    assert got == plain_negatives(rows, 10) and len(got) > 300
    assert hard_negatives.mine(df.limit(0), every=10).count() == 0


def test_digest_relabels_and_drops_what_is_not_finite(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.random(6)]) for i in range(220)] + [(350, 1, [math.nan] * 6), (400, 1, [math.inf] * 6)]
    want = [(i, (own + 1) % 10 if i % 7 == 0 else own, [math.floor(256 * x) for x in v]) for i, own, v in rows[:220]]
    assert as_rows(hard_negatives.digest(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))) == plain_negatives(want, 50)


def test_node_pairs_are_pruned_in_groups():
    """On clustered rows most pairs are settled by intervals, and no answer is lost."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(24, 16))
    centres *= 1200 / np.sqrt((centres**2).sum(axis=1))[:, None]
    rows = np.floor(np.concatenate([c + rng.normal(size=(200, 16)) * 8 for c in centres])).astype(np.int64)
    labels, ids = np.repeat(np.arange(24) % 2, 200), np.arange(len(rows))
    at = np.arange(0, len(rows), 2)
    asks = hard_negatives.Asks(np.arange(len(at)), np.zeros(len(at), dtype=np.int64), np.full(len(at), -(2**60)), np.full(len(at), 2**60))
    got, share = hard_negatives.search(ids[at], labels[at], rows[at], asks, ids, labels, rows, 5, True)
    exact = rows[at] @ rows.T
    exact[(labels[at, None] != labels[None]) | (ids[at, None] == ids[None])] = -(2**61)
    for n in range(0, len(at), 17):
        assert got[got["ask"] == n]["vec_id"].tolist() == sorted(np.argsort(-exact[n], kind="stable")[:5].tolist(), key=lambda i: (-exact[n, i], i))
    assert share < 0.15  # labels alone leave a half


def test_intervals_hold_all_products():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(40, 7)) + 1, rng.normal(size=(50, 7)) - 2
    ball = lambda x: (x.mean(axis=0), np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).max()))
    (p, r), (q, s) = ball(a), ball(b)
    low, high = hard_negatives.interval(p, r, q, s)
    assert low <= (a @ b.T).min() and (a @ b.T).max() <= high


# ---- divergence --------------------------------------------------------------------

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(docs, documents=3, ranks=200):
    docs = [(a or "", b or "", TERMS.findall((t or "").translate(LOW))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w, n in held.items() if n >= documents]
        count = {s: collections.Counter(w for _, b, ws in own for w in ws if b == s and held[w] >= documents) for s in {d[1] for d in own}}
        every = sum(count.values(), collections.Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = sorted((-sum(f(p(count[s], w), p(count[o], w)) for w in kept), o.encode()) for o in count if o != s)
            term = sorted((-f(p(count[s], w), p(every, w)), w.encode()) for w in kept if count[s][w] and p(count[s], w) > p(every, w))[:ranks]
            out += [(lang, s, part, w.decode(), -v, n) for part, found in (("pair", pair), ("term", term)) for n, (v, w) in enumerate(found, 1)]
    return sorted(out)


def test_audit_is_that_of_a_loop(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("The", "été", "數", "zebra", "x") for b in ("a", "B", "ß", "c", "\xa0", "q", "rr")]
    docs = [(r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", "Ünder", None]), r.choice([" ", "1", "-\n"]).join(r.choices(vocabulary, k=r.randint(0, 25), weights=range(1, 36)))) for _ in range(120)]
    docs += [("en", "empty", None), ("xx", "a", "once"), ("xx", "b", ""), ("yy", "", "alone alone"), ("en", "long", "zebrac " * 100_000 + "thea"), *[("en", "copies", "Thea thea zebraB")] * 4]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, n int, term string")
    names = ("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(x[c] for c in names) for x in divergence.digest(df).collect()) == plain_audit(docs)
    few = sorted(tuple(x[c] for c in names) for x in divergence.audit(df, ranks=2).collect())
    assert few == plain_audit(docs, ranks=2) and len(few) < len(plain_audit(docs))
    assert divergence.digest(df.limit(0)).count() == 0


def test_probabilities_are_exact_beyond_longs(spark):
    rows = [(0, 0, 1), (5, 10, 3), (8_999_999_999, 9_000_000_000, 7), (9_000_000_001, 10**13, 12), (10**14, 10**15, 10**6)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.probability(*map(F.col, "cnv"))).collect()
    assert [x[0] for x in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]
