"""Operators on documents, against brute force and on rows of every awkward kind."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import bagminhash, language, mixing, near_dup, packing, pii, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, shard string, size int, key string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "za") for b in ("n", "r", "st", "ve", "x", "qu", "bo")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"neu{r.randrange(99)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base, out = prose(1, 150), []
    add = lambda i, t, lang="xx", s="a": out.append((i, t, lang, s, len(t or ""), 7, "s", 3, "k"))
    add(0, None)
    add(1, "")
    add(2, " \t\n")
    for i in range(3, 9):
        add(i, base)  # exact copies
    for i in range(9, 25):
        add(i, edited(base, i, 1 + i % 3), s=None)  # near copies
    add(25, prose(3, 90), None)
    add(25, prose(3, 90), None)  # a repeated row
    add(None, prose(4, 60), s="b")
    add(None, prose(5, 60), s="b")
    add(26, "one two three", s="c")
    add(27, "one two three", s="c")
    add(28, prose(6, 9000), s="d")
    add(29, "x" * 5000, s="d")
    for i in range(30, 60):
        add(i, prose(100 + i, 40 + i), s=random.Random(i).choice("abcd"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- near copies -------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_classes_are_those_of_brute_force(docs, rows):
    found = collections.defaultdict(list)
    for n, r in enumerate(near_dup.classify(docs).collect()):
        alone = r["node"] is None or r["key"] is None
        found[("alone", n) if alone else r["class_id"]].append(str(r["key"]))
        assert r["class_size"] >= 1
    assert sorted(map(sorted, found.values())) == brute_classes(rows)


def test_one_of_each_class_stays(docs, none):
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert {"0", "1", "2", "3", "25", "26", "28", "29"} <= set(ids) and "27" not in ids and "8" not in ids
    assert ids.count("25") == 1 and ids.count("None") == 2
    clash = docs.withColumnRenamed("shard", "keep").withColumn("Node_", F.lit(1))
    assert near_dup.keep_first(clash).columns == clash.columns and near_dup.keep_first(clash).select("node").distinct().collect() == [(7,)]
    assert near_dup.keep_first(none).count() == 0 and near_dup.digest(none).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base = prose(11, 120)
    rows = [(i, edited(base, i, i % 5), "", "", 0, 0, "", 0, "") for i in range(60)]
    got = collections.defaultdict(list)
    for r in near_dup.classify(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["class_id"]].append(str(r["key"]))
    assert sorted(map(sorted, got.values())) == brute_classes(rows)


@pytest.mark.parametrize("small", [0, 4096])
def test_components_are_those_of_brute_force(spark, monkeypatch, small):
    from paperloom.llm import components

    monkeypatch.setattr(components, "SMALL", small)
    r = random.Random(7)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = lambda of: sorted(sorted(x for x in of if of[x] == c) for c in set(of.values()))
    assert groups(found) == groups({k: v for k, v in root.items() if k in found}) and set(found) == {x for a, b in edges if a != b for x in (a, b)}


def test_skewed_joins_keep_every_row(spark, monkeypatch):
    from paperloom.llm import common

    monkeypatch.setattr(common, "HOT", 10)
    rows = [(1, i) for i in range(50)] + [(None, i) for i in range(20)] + [(i, i) for i in range(2, 30)]
    a = spark.createDataFrame(rows, "k long, salt int")
    b = spark.createDataFrame([(i, f"v{i}") for i in range(0, 20)], "k long, v string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.join_skewed(a, b, "k", how).select("k", "salt", "v").collect()), key=str)
        assert got == sorted(map(tuple, a.join(b, "k", how).select("k", "salt", "v").collect()), key=str)


def test_signatures_are_unbiased():
    a = "a b c a b c a b d e f g a b c a b c a b q r a b c".split() * 3
    b = a[:50] + ["z"] * 6 + a[56:]
    x, y = " ".join(a), " ".join(b)
    exact = bagminhash.similarity(bagminhash.multiset(x), bagminhash.multiset(y))
    s, t = shingles(x), shingles(y)
    assert exact == pytest.approx(sum((s & t).values()) / sum((s | t).values()))
    found, _ = bagminhash.signatures([x, y], 4000)
    assert (found[0] == found[1]).mean() == pytest.approx(exact, abs=0.04)


# ---- mixing ------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[k] for k in open_)
        left = 0.0
        for k in list(open_):
            target[k] += share * weight[k]
            if target[k] >= 2 * sizes[k]:
                left += target[k] - 2 * sizes[k]
                target[k] = 2.0 * sizes[k]
                open_.discard(k)
    return target


def test_mix(docs, rows, none):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    for r in mixed:
        assert r["mix_target"] == pytest.approx(want[r["source"]]) and r["mix_source_size"] == sizes[r["source"]]
        assert int(r["mix_rate"]) <= r["mix_copies"] <= min(2, int(r["mix_rate"]) + 1)
    out = mixing.emit(mixing.mix(docs))
    assert out.columns == docs.columns and out.count() == sum(r["mix_copies"] for r in mixed)
    named = docs.withColumn("mix_note", F.lit("x")).withColumn("mix_size", F.lit("own")).withColumn("row", F.lit(1))
    kept = mixing.repeat(named)
    assert kept.columns == named.columns and kept.count() == out.count() and {r[0] for r in kept.select("mix_size").distinct().collect()} == {"own"}
    assert "mix_note" in mixing.mix(named).columns
    again = mixing.digest(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.digest(docs.repartition(7)).collect()))
    assert mixing.digest(none).count() == 0


def test_taken_words_come_near_their_targets(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 11 + 1).cast("int")).alias("text"))
    for r in mixing.digest(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert r["t"] == pytest.approx(r["g"], rel=0.06)


# ---- personal data -----------------------------------------------------------------

_E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_C = re.compile(r"[0-9]([\x20-]?[0-9])+")
_P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(x):
    o = [(m.start(), 0, m.end()) for m in _E.finditer(x)]
    o += [(m.start(), 1, m.end()) for m in _I.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    o += [(m.start(), 2, m.end()) for m in _C.finditer(x) if 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    o += [(m.start(), 3, m.end()) for m in _P.finditer(x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(o)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(5)
    parts = ["1", "22", "255", ".", "..", "@", "a", "-", "+", " ", "(", ")", "0", "4111111111111111", "x.y", "é", "\n"]
    for _ in range(5000):
        x = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        assert pii.base_spans(x) == brute_spans(x), x


def test_the_field_finds_what_the_patterns_lose_and_leaves_look_alikes():
    model = pii.field()
    kinds = lambda t: [(k, t[s:e], b) for k, s, e, b in pii.spans_of(t, model)]
    assert kinds("ask +1 (988) 555-2485 4524132264652876 or so") == [("phone", "+1 (988) 555-2485", False), ("card", "4524132264652876", False)]
    assert kinds("write to maria at posteo dot net today") == [("email", "maria at posteo dot net", False)]
    assert kinds("on 2024-01-02 10:20 he paid 1,234,567.89 for AKIA1234567XY") == []
    tp = fp = fn = 0
    for text, gold in pii.examples(150, seed=99):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        got, gold = set(model.decode(text, tokens, [False] * len(tokens))), set(gold)
        tp, fp, fn = tp + len(got & gold), fp + len(got - gold), fn + len(gold - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


#: Written by hand, not by the training's rules.
BY_HAND = [
    ("Reach Ann on (415) 555-0132 or ann.lee [at] corp [dot] com.", [("phone", "(415) 555-0132"), ("email", "ann.lee [at] corp [dot] com")]),
    ("Server 10[.]0[.]0[.]7 fell; ticket 20240102.", [("ip", "10[.]0[.]0[.]7")]),
    ("Pay to 4111.1111.1111.1111 by Friday", [("card", "4111.1111.1111.1111")]),
    ("fax: 212-555-0187 tel: 646-555-0123", [("phone", "212-555-0187"), ("phone", "646-555-0123")]),
    ("mail jo (at) uni (dot) edu", [("email", "jo (at) uni (dot) edu")]),
    ("order 1234-5678-9012 shipped 2024-05-06", []),
    ("meet me at the station dot", []),
    ("call +44 20 7946 0958 now", [("phone", "+44 20 7946 0958")]),
    ("my card is 5500 0000 0000 0004 today", [("card", "5500 0000 0000 0004")]),
    ("12 34 56 78 90 12", []),
    ("pi is 3.14159265358979 and e 2.71828182845904", []),
    ("we were 3 at 10 and 5 at 11, total 1,234,567 of 9,876,543", []),
    ("card 4111 1111 1111 1111 4012888888881881", [("card", "4111 1111 1111 1111"), ("card", "4012888888881881")]),
]


def test_the_field_on_texts_written_by_hand():
    model, hit, wrong, lost = pii.field(), collections.Counter(), collections.Counter(), collections.Counter()
    for text, gold in BY_HAND:
        got = collections.Counter((k, text[s:e]) for k, s, e, _ in pii.spans_of(text, model))
        want = collections.Counter(gold)
        for (k, _), n in (got & want).items():
            hit[k] += n
        wrong.update(k for k, _ in (got - want).elements())
        lost.update(k for k, _ in (want - got).elements())
    assert all(hit[k] >= 2 or k == "ip" for k in pii.KINDS) and wrong.total() <= 1 and lost.total() <= 1


def test_kinds_depend_on_what_stands_before_them():
    """The programme finds the best of all segmentations under segment and transition weights."""
    import numpy as np

    model = pii.Field()
    r = np.random.default_rng(4)
    model.w, model.t = r.normal(size=model.w.shape) * 0.4, r.normal(size=model.t.shape)
    for text in ("a 1234 5678 9012 b", "+1 415 555 0132", "x@y.zz 10.0.0.12", "4111 1111 1111 1111"):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        free = [False] * len(tokens)
        segments = model.segments(text, tokens, free)
        scores = model.scores(segments)
        best = (0.0, [])

        def walk(at, before, total, chosen):
            nonlocal best
            if at == len(tokens):
                best = max(best, (total, chosen), key=lambda x: x[0])
                return
            walk(at + 1, 4, total, chosen)
            for n, (i, j, _) in enumerate(segments):
                if i == at:
                    for k in range(4):
                        walk(j + 1, k, total + scores[n, k] + model.t[before, k], [*chosen, (tokens[i][0], k, tokens[j][1])])

        walk(0, 4, 0.0, [])
        assert model.decode(text, tokens, free) == best[1]


def test_the_field_adds_spans_on_the_test_tables(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    added = [x for r in pii.find(spark.read.parquet(path)).select("pii").collect() for x in r["pii"] if not x["base"]]
    assert added  # without the field there is none


def test_the_hint_hides_nothing_from_the_field():
    model = pii.field()
    for ip in ("10[.]1[.]2[.]3", "8[.]8[.]8[.]8", "192[.]0[.]2[.]1"):
        assert pii.spans_of(f"seen at {ip} today", model) == [("ip", 8, 8 + len(ip), False)]
    assert [s[0] for s in pii.spans_of("write to JOHN AT EXAMPLE DOT COM today", model)] == ["email"]
    far = f"write to john at {'example' * 20} dot com today"
    assert pii.spans_of(far, model) == [("email", 9, len(far) - 6, False)]

    def whole(text):
        base = pii.base_spans(text)
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        blocked = [any(s < e2 and e > s2 for s2, _, e2 in base) for s, e in tokens]
        return sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in model.decode(text, tokens, blocked)])

    made = [text for text, _ in pii.examples(400, seed=5)]
    for i, text in enumerate(made):
        # long words, many of them and several texts in one: windows reach by tokens, whatever their length
        stretched = re.sub(r"[a-z]{4,}", lambda m: m[0] * 60, text)
        for t in (text, text.upper(), stretched, f" {'so ' * 40}".join([stretched, *made[i : i + 3]])):
            assert pii.spans_of(t, model) == [(pii.KINDS[k], s, e, b) for s, k, e, b in whole(t)], t


def test_pii_digest_and_redaction(spark, docs, none, rows):
    text = "a b@c.de 10.0.0.1 é 4111 1111 1111 1111 +1 (988) 555-2485"
    one = spark.createDataFrame([(1, text, 99)], "doc_id long, text string, n_chars int")
    got = pii.digest(one).first()
    want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(text))
    assert got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got["spans"] == want
    clean = pii.redact(one).first()
    assert "[EMAIL] [IP] é" in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert pii.digest(docs).count() == len(rows) and pii.digest(none).count() == 0
    assert pii.redact(docs).columns == docs.columns and [r["text"] for r in pii.redact(docs).where("doc_id = 0").collect()] == [None]


def test_pii_counts_of_kinds_are_of_base_spans(spark):
    texts = ["seen at 10[.]1[.]2[.]3 today", "10.0.0.1 and 10[.]1[.]2[.]3, a@b.de", "write to JOHN AT EXAMPLE DOT COM today", "", None]
    got = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    base = [brute_spans(texts[r["doc_id"]] or "") for r in got]
    assert [[r[f"n_{k}"] for k in pii.KINDS] for r in got] == [[sum(x[1] == k for x in b) for k in range(4)] for b in base]
    assert {r["doc_id"]: r["n_spans"] for r in got} == {0: 1, 1: 3, 2: 1, 3: 0, 4: 0}


# ---- packing -----------------------------------------------------------------------


def test_every_id_lies_in_one_piece(docs, rows, none, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(docs, shard_tokens=6_000, with_ids=True).collect()
    ids = collections.Counter((r[0], tuple(own.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows)
    sequences, texts = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p["ids"])) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        texts[p["doc_id"]].append(p)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0
    joined = collections.Counter()
    for key, found in texts.items():
        if key in (25, None):
            continue
        found.sort(key=lambda p: p["start"])
        joined[key, tuple(i for p in found for i in p["ids"])] += 1
    assert joined == collections.Counter({k: n for k, n in ids.items() if k[0] not in (25, None)})
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) * n for k, n in ids.items())
    assert packing.digest(none).count() == 0


def test_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.encoder("word_bpe_49k.json")
    r = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "'s", "é", "ß", "中", "😀", "1", ".", "!!", "\x1c", "\x85", "　", "<|endoftext|>", "<|", "Σ", "́", "The", "İ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    assert [x.tolist() for x in mine.encode(texts)] == [own.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_bm25_ranks_by_shared_rare_terms():
    import numpy as np

    docs = [np.array(x, dtype="<u4") for x in ([5, 6, 7], [5, 6, 8], [9, 10, 11], [12, 13, 14], [15, 16, 17])]
    scores = packing.Index(docs).scores(0)
    assert scores[0] > scores[1] > scores[2] == 0


def brute_bm25(docs, seed):
    """Scores by the formula, one document and term at a time."""
    import math

    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        total = 0.0
        for t in set(docs[seed].tolist()):
            df = sum(t in x.tolist() for x in docs)
            idf, tf = max(math.log((n - df + 0.5) / (df + 0.5)), 0), d.tolist().count(t)
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(total)
    return out


def random_docs(seed, n, words=60):
    import numpy as np

    r = random.Random(seed)
    return [np.array([int(r.paretovariate(0.7)) % words for _ in range(r.randint(1, 40))], dtype="<u4") for _ in range(n)]


def test_scores_and_windows_are_those_of_brute_force():
    for seed in range(6):
        docs = random_docs(seed, 30)
        index = packing.Index(docs)
        for i in (0, 7, 29):
            assert index.scores(i) == pytest.approx(brute_bm25(docs, i))
        # the windows, by the rule: best unused neighbours in their order, the first that does not fit is cut
        want, unused, at = [], [True] * len(docs), (-1, 0)
        while any(unused) or at[0] >= 0:
            if at[0] < 0:
                at = (unused.index(True), 0)
                unused[at[0]] = False
            d, begin = at
            at = (-1, 0)
            size = len(docs[d]) - begin
            if size >= 32:
                want.append([(d, begin, 32)])
                at = (d, begin + 32) if size > 32 else at
                continue
            window, room, inside = [(d, begin, size)], 32 - size, {docs[d].tobytes()}
            scores = brute_bm25(docs, d)
            order = sorted((i for i in range(len(docs)) if unused[i]), key=lambda i: (-round(scores[i], 9), i))
            first = []
            for i in order:
                if docs[i].tobytes() in inside:
                    continue
                first.append(i)
                inside.add(docs[i].tobytes())
                if sum(len(docs[j]) for j in first) >= room:
                    break
            for i in first + [i for i in order if i not in first]:
                if not room:
                    break
                take = min(room, len(docs[i]))
                window.append((i, 0, take))
                unused[i] = False
                room -= take
                if take < len(docs[i]):
                    at = (i, take)
            if room:
                break
            want.append(window)
        got = packing.fill(docs, 32)
        assert got[: len(want)] == want and sum(n for s in got for _, _, n in s) == sum(map(len, docs))


def test_equal_texts_start_in_different_windows():
    import numpy as np

    docs = [np.arange(100 * (i // 2), 100 * (i // 2) + 300 + i // 2, dtype="<u4") % 5000 for i in range(400)]  # each twice
    starts = [[d // 2 for d, begin, _ in s if not begin] for s in packing.fill(docs)]
    assert sum(len(s) - len(set(s)) for s in starts[:-12]) == 0


def test_shards_hold_their_share_and_hot_terms_have_several():
    import numpy as np

    sizes = np.array([0, 400, 5000, 300, 900, 200, 0, 100])
    first, parts = packing.shards_of(sizes, 1000)
    assert parts.tolist() == [1, 1, 5, 1, 1, 1, 1, 1]
    used = [set(range(f, f + p)) for f, p, n in zip(first, parts, sizes) if n]
    hot = used[1]
    assert all(not (hot & u) for i, u in enumerate(used) if i != 1) and max(np.bincount(np.delete(first, 2), weights=np.delete(sizes, 2))) < 2000


# ---- token counts ------------------------------------------------------------------


def test_counts_are_the_tokenizers_own(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "中", "😀", "1", "23", ".", "!!", "\x1c", "\x85", "　", "<|endoftext|>", "<|", "\r\n", "the", "x" * 50]
    mine = token_counts.counter(token_counts.vocabulary_path())
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert mine.count(t) == len(own.encode(t, add_special_tokens=False).ids), t
    want = collections.Counter((i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in rows)
    assert collections.Counter(map(tuple, token_counts.digest(docs).collect())) == want
    assert token_counts.digest(none).count() == 0


def test_long_texts_are_counted_in_slices(monkeypatch):
    mine = token_counts.counter(token_counts.vocabulary_path())
    text = prose(8, 4000)
    whole = mine.count(text)
    monkeypatch.setattr(token_counts, "SLICE", 100)
    assert mine.count(text) == whole


# ---- languages ---------------------------------------------------------------------


def test_languages_held_out(spark, none):
    words = {"la": "ali bor cal dem eru fas".split(), "lb": "zug yth xan wop vek uls".split(), "lc": "héé ïïk öön çöç ñañ üüm".split()}
    rows = [(i, " ".join(random.Random(i).choice(words[k]) + random.Random(-i).choice(words[k]) for _ in range(30)), k) for i in range(300) for k in [("la", "lb", "lc")[i % 3]]]
    rows += [(1000, None, "la"), (1001, "", "la"), (1002, "123 !!", "lb"), (None, rows[0][1], "zz"), (1003, rows[1][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = {r["doc_id"]: r for r in language.digest(docs).collect()}
    truth = {i: k for i, _, k in rows}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] == (i in set(held)) for i in range(300))
    assert sum(out[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.98
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1000, 1001, 1002)) and out[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in out.values()) and "zz" not in {r["lang_pred"] for r in out.values()}
    assert language.keep_known(docs).columns == docs.columns
    assert language.digest(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.digest(unlabelled).collect()} == {"und"}


def test_the_margin_does_not_shrink_with_length(spark):
    words = {"la": "ali bor cal dem eru fas".split(), "lb": "zug yth xan wop vek uls".split()}
    make = lambda i, k, n: " ".join(random.Random(i + j).choice(words[k]) + random.Random(-i - j).choice(words[k]) for j in range(n))
    docs = spark.createDataFrame([(i, make(1000 * i, k, 30), k) for i in range(60) for k in [("la", "lb")[i % 2]]], "doc_id long, text string, lang string")
    model = language.learn(docs)
    short = make(7, "la", 1200)
    long = " ".join(make(10**6 + 5000 * i, "la", 1200) for i in range(80))
    got = [r for r in language.identify(spark.createDataFrame([(short,), (long,)], "text string"), model).collect()]
    assert [r["lang_pred"] for r in got] == ["la", "la"] and got[1]["score"] > 0.5 * got[0]["score"]


def test_languages_are_those_of_a_loop_over_compressors(spark):
    """The plain rule: each text's blocks with each dictionary, whole table; in one pass and in several."""
    import zstandard

    rows = [(i, t, k) for i in range(90) for k in [f"l{i % 30:02}"] for t in [" ".join(random.Random(i % 30 + 7 * j).choice(["ab", "cd", "xyz", "qu"]) + k[1:] + random.Random(i + j).choice("aeiou") for j in range(20 + i))]]
    rows += [(200, rows[3][1], None), (201, "!", "l00"), (202, rows[5][1] * 200, "l05")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(i, t, k) for i, t, k in rows if k and zlib.crc32(str(i).encode()) % 3 != 1]
    number = collections.Counter(k for _, _, k in learned)
    names = sorted(number, key=lambda k: (-number[k], k))
    dictionaries = {}
    for k in names:
        texts = [t for _, t, own in learned if own == k]
        short = [t for t in texts if len(t) <= language.LONG]
        dictionaries[k] = "\n".join(sorted(set(short or texts))).lower().encode()
    want = {}
    for i, t, _ in rows:
        sizes = []
        for at, k in enumerate(names):
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(dict_data=d, level=language.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            data = t.lower().encode()
            sizes.append((sum(len(c.compress(data[x : x + language.BLOCK])) for x in range(0, len(data), language.BLOCK)), at))
        sizes.sort()
        want[i] = ("und", 0.0) if t == "!" else (names[sizes[0][1]], 1 - sizes[0][0] / sizes[1][0])
    for held in (language.HELD, 3000):
        model = language.learn(docs, held=held)
        assert (model.passes > 3) == (held == 3000)
        assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()} == want


def test_no_label_is_dropped(spark):
    rows = [(3 * i + j, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 30, f"l{i}") for i in range(300) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang_pred"] for r in language.digest(docs).collect()}
    assert len(got) > 256
