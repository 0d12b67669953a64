"""Joins of alike strings against all pairs."""

import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import spaced_title
from paperloom.operators import resolve, similarity


def perturbed(r, title):
    out = list(title)
    for _ in range(r.randint(0, 6)):
        at = r.randrange(len(out) + 1)
        r.choice([lambda: out.insert(at, r.choice("abcdefg ")), lambda: out.pop(min(at, len(out) - 1)) if out else None, lambda: out.__setitem__(min(at, len(out) - 1), r.choice("xyz")) if out else None])()
    if r.random() < 0.2:  # a word moves
        words = "".join(out).split(" ")
        r.shuffle(words)
        return " ".join(words)
    return "".join(out)


def titles(r, n):
    words = ["".join(r.choices("abcdeinorst", k=r.randint(1, 11))) for _ in range(60)]
    return [" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize(("ratio", "seed"), [(0.92, 1), (0.85, 2)])
def test_no_pair_is_lost(spark, ratio, seed):
    r = random.Random(seed)
    left = titles(r, 250) + ["a", "ab", "abc", "aaaa", "aaaaa", "aaaaaaaaaa", "visualnavigationbenchmark", "x y", "été à é"]
    right = [perturbed(r, r.choice(left)) for _ in range(400)] + titles(r, 60) + ["visualnavigationbenchmarks", "a", "ab", "aaaaaa", "abc ", "", "été à e"]
    frame = lambda x: spark.createDataFrame([(i, t) for i, t in enumerate(x)], "id long, text string")
    got = {(x["a"], x["b"]) for x in similarity.alike(frame(left), frame(right), ratio).collect()}
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and SequenceMatcher(None, b, a).ratio() >= ratio}
    assert got == want and len(want) > 100
    tried = similarity.candidates(frame(left), frame(right), ratio).count()
    assert tried < 0.2 * len(left) * len(right)
    assert similarity.candidates(frame(left), frame(right), ratio, lot=3).count() == tried
    with pytest.raises(ValueError):
        similarity.candidates(frame(left), frame(right), 0.7)


def test_twins_are_those_of_a_loop(spark):
    r = random.Random(7)
    index = [(t, f"p{i}") for i, t in enumerate(titles(r, 900))]
    index += [("two words", "q1"), ("two wards", "q2"), ("Visualnavigationbenchmark", "q3"), ("?!", "q4"), (index[0][0].upper() + "!", "q0")]
    papers = [(i, perturbed(r, r.choice(index)[0])) for i in range(2000)] + [(5000, "visualnavigationbenchmarks"), (5001, ""), (5002, None), (5003, "two words?")]
    key = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())
    by = {}
    for t, f in index:
        by[key(t)] = min(f, by.get(key(t), f))
    by.pop("")
    want = {}
    for uid, t in papers:
        k = key(t)
        if k in by:
            want[uid] = (by[k], True)
        elif k:
            most = max(((SequenceMatcher(None, g, k).ratio(), g) for g in by if abs(len(g) - len(k)) <= 0.09 * (len(g) + len(k))), default=(0, ""))
            if most[0] >= 0.92:
                want[uid] = (by[most[1]], False)
    df = spark.createDataFrame(papers, "uid long, title string")
    got = {x["uid"]: (x["found"], x["exact"]) for x in resolve.twin_by_title(df, spark.createDataFrame(index, "title string, found string")).collect()}
    assert got == want and sum(not e for _, e in want.values()) > 200 and got[5000] == ("q3", False)
    assert df.select(spaced_title(F.col("title"))).count() == len(papers)


def test_one_surname_compares_few_pairs(spark):
    """3,000 titles under one key: under a tenth of all pairs is looked at."""
    r = random.Random(3)
    rows = [(i, "wang", t) for i, t in enumerate(titles(r, 3000))]
    df = spark.createDataFrame(rows, "id long, s string, text string")
    assert similarity.candidates(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.9, ("s",)).count() < 0.1 * 1500 * 1500


@pytest.mark.parametrize(("few", "lot"), [(1024, 4096), (40, 7), (0, 50)])
def test_keys_of_few_strings_need_no_grams(spark, monkeypatch, few, lot):
    r = random.Random(5)
    left = [(i, i % 4, t) for i, t in enumerate(titles(r, 120))]
    right = [(i, i % 3 + i % 2 * 2, perturbed(r, r.choice(left)[2])) for i in range(240)] + [(240, 1, ""), (241, 1, None), (242, 9, left[1][2])]
    frame = lambda x: spark.createDataFrame(x, "id long, k long, text string")
    indexed, whole = [], similarity.candidates
    monkeypatch.setattr(similarity, "FEW", few)
    monkeypatch.setattr(similarity, "LOT", lot)
    monkeypatch.setattr(similarity, "candidates", lambda a, b, *more: indexed.append(a.count()) or whole(a, b, *more))
    got = sorted((x["a"], x["b"]) for x in similarity.alike(frame(left), frame(right), 0.85, ("k",)).collect())
    assert got == sorted((i, j) for i, k, a in left for j, m, b in right if k == m and a and b and SequenceMatcher(None, b, a).ratio() >= 0.85) and len(got) > 30
    assert (indexed == [0]) == (few == 1024)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_twins_of_parts_are_those_of_a_loop(spark):
    import re

    from paperloom import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    key = lambda r: re.sub("[^a-z0-9]+", " ", f"{r['p_name']} {r['p_type']} {r['p_brand']}".lower()).strip()
    index, want = {}, {}
    for r in rows:
        if r["p_partkey"] % 2 == 0:
            index[key(r)] = min(r["p_partkey"], index.get(key(r), r["p_partkey"]))
    for r in rows:
        if r["p_partkey"] % 2:
            most = max((SequenceMatcher(None, g, key(r)).ratio(), g) for g in index)
            if key(r) in index or most[0] >= 0.92:
                want[r["p_partkey"]] = (index[key(r)] if key(r) in index else index[most[1]], key(r) in index)
    got = {r["uid"]: (r["found"], r["exact"]) for r in queries.queries()["twins_alike"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(not e for _, e in want.values())
