"""Operators on conversations, vectors and pages; the registry and the pipeline."""

import collections
import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import ann, chat, html, knn, queries

# ---- chat --------------------------------------------------------------------------


def test_layouts_become_one_form(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"prompt":"q","completion":"a"}',
        '{"response":"a","prompt":"q"}',
        '{"instruction":"q","input":"","output":"a"}',
        '{"question":"q","answer":"a"}',
    ]
    df = spark.createDataFrame([(r, "clash") for r in records + [None, "no json", '{"other":1}']], "record string, turns string")
    got = chat.canonical(df).select("record", "layout", "turns").collect()
    by = {r["record"]: r for r in got}
    assert all([tuple(t) for t in by[r]["turns"]] == [("user", "q"), ("assistant", "a")] for r in records)
    assert all(by[r]["turns"] is None and by[r]["layout"] is None for r in (None, "no json", '{"other":1}'))
    assert len({x.fingerprint for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_conversations_round_trip(spark):
    nasty = ["<|end|>\n", "\\<|", "<\\|turn|>", "a<", "|>b", "\\", "", None, "x" * 20_000, "é😀\n", "<|text|>"]
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(nasty)) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(99, 0, "assistant", "same"), (99, 0, "assistant", "same")]
    got = {x["conv_id"]: x for x in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))).collect()}
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    own = chat.digest(spark.createDataFrame([(-7, 3, "user", "mine"), (-7, 0, "user", chat.PROBE)], "conv_id long, turn long, role string, text string")).collect()
    assert [(x["conv_id"], x["n_turns"]) for x in own] == [(-7, 4)]  # the table's own rows of that conversation join the two
    clash = spark.createDataFrame([('{"prompt":"q","response":"a"}', "1", "2")], "r string, record string, pieces string")
    done = chat.render(chat.canonical(clash, "r"))
    assert done.columns == ["r", "record", "pieces", "fingerprint", "layout", "turns", "formatted", "loss_spans"] and done.first()["record"] == "1"
    shapes = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "user", "q"), (4, 0, "critic", "q"), (5, 0, "system", ""), (5, 1, "user", "q"), (5, 2, "assistant", "a")]
    found = chat.canonical(chat.records(spark.createDataFrame(shapes, "conv_id long, turn long, role string, text string")))
    assert {r["conv_id"]: r["layout"] for r in found.collect()} == {-7: "prompt_response", 1: "prompt_response", 2: "system_prompt_response", 3: "conversations", 4: "messages", 5: "messages"}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [x["conv_id"] for x in chat.digest(empty).collect()] == [-7]


# ---- vectors -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3]) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(300)]  # one very common vector
    rows += [(3000, None), (3100, [None] * 8), (3200, [math.nan] * 8), (3300, [math.inf] + [0.0] * 7), (3400, [0.0] * 8), (None, rows[0][1]), (3500, [])]
    return rows


def test_inner_products_are_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 5)
    monkeypatch.setattr(knn, "ROWS", 100)
    monkeypatch.setattr(knn, "FEWEST", 7)
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in knn.digest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in usable if i % 50 == 0):
        want = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {i for i in usable if i % 50 == 0}
    assert knn.digest(df.limit(0)).count() == 0
    few = knn.digest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_widths_are_searches_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(50, [1.0, 2.0, 3.0]), (700, [1.0, 0.0, 1.0]), (701, [0.0, 2.0, 1.0])]
    rows = [r for r in rows if r != rows[50]]
    got = collections.defaultdict(list)
    for r in knn.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {i for i, _ in rows if i % 50 == 0} and got[50] == [701, 700] and got[700] == [50, 701]
    assert all(len(got[q]) == 5 for q in (0, 100, 150, 200, 250))


def test_scores_are_exact_or_clipped():
    big = np.array([[2**40, 3], [-(2**62), 1]], dtype=np.int64)
    small = np.array([[2**20 + 1, 2], [5, 7]], dtype=np.int64)
    got = knn.top(np.array([1, 2]), big, np.array([10, 11]), small, 2)
    exact = [[2**40 * (2**20 + 1) + 6, 2**40 * 5 + 21], [max(-(2**62) * (2**20 + 1) + 2, -(2**63)), max(-(2**62) * 5 + 7, -(2**63))]]
    assert got["score"].tolist() == [*sorted(exact[0], reverse=True), *sorted(exact[1], reverse=True)]


def test_queries_go_where_answers_can_be():
    """On clustered rows a query is asked in few cells, and never too few."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    rows = np.floor(256 * np.concatenate([c + 0.01 * rng.normal(size=(100, 16)) for c in centres]))
    points = knn.pivots_of(rows[:: len(rows) // 500], 40)
    cell, distance = knn.nearest(rows, points)
    radius = np.array([distance[cell == c].max(initial=-1) for c in range(len(points))])
    norm = np.array([np.sqrt((rows[cell == c] ** 2).sum(axis=1)).max(initial=0) for c in range(len(points))])
    ids = np.arange(len(rows))
    least = knn.least_scores(ids[:200], rows[:200], ids[::4], rows[::4], 5)
    wanted = (knn.most_scores(rows[:200], points, radius, norm) >= least[:, None]) & (radius >= 0)
    exact = rows[:200] @ rows.T
    exact[ids[:200], ids[:200]] = -np.inf
    assert all(wanted[q, cell[i]] for q in range(200) for i in np.argsort(-exact[q])[:5])
    assert wanted.sum(axis=1).mean() < len(points) / 4


def test_neighbours_found(spark, vectors):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in ann.digest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {i: np.array(v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    hits = asked = 0
    for q in (i for i in usable if i % 100 == 0):
        want = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        hits, asked = hits + len({i for i, _ in got[q]} & {i for _, i in want}), asked + 10
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        assert all(s == pytest.approx(float(np.sqrt(((usable[q] - usable[i]) ** 2).sum())), abs=1e-12) for i, s in got[q])
    assert hits / asked >= 0.9 and set(got) == {i for i in usable if i % 100 == 0}
    assert ann.digest(df.limit(0)).count() == 0
    assert [r["vec_id"] for r in ann.digest(df.where("vec_id in (0, 1, 2)")).orderBy("rank").collect()] in ([1, 2], [2, 1])


@pytest.mark.parametrize("widths", [8, 1])
def test_neighbours_of_every_width(spark, monkeypatch, widths):
    monkeypatch.setattr(ann, "WIDTHS", widths)  # at 1 the narrow rows have no codebooks
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + 20 * i, rng.normal(size=4).tolist()) for i in range(40)] + [(5000, [1.0, 2.0])]
    got = collections.defaultdict(list)
    for r in ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q, v in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:10]
        if q % 100 == 0:
            assert got.pop(q, []) == [i for _, i in near]
    assert not got


def test_codes_sum_to_what_their_norm_says():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    books = ann.learn(x, 6, 32)
    codes, norms = ann.encode(x, books)
    sums = sum(books[m][codes[:, m]] for m in range(6))
    assert np.allclose((sums**2).sum(axis=1), norms, rtol=1e-3)
    exact = ((x[:5, None] - sums[None]) ** 2).sum(axis=2) - (x[:5] ** 2).sum(axis=1)[:, None]
    assert np.allclose(ann.lookup(x[:5], codes, norms, books), exact, atol=1e-2)
    assert ((x - sums) ** 2).sum() < 0.6 * (x**2).sum()


# ---- pages -------------------------------------------------------------------------


def page(i, paragraphs):
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", f"t{i % 3}"))
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"<html><head><title>T{i}</title><script>var t='</p>';</script></head><body class='has-sidebar'><header>Site {i}</header><nav><ul>{menu}</ul></nav><div class='ad'>Buy {i}</div><div id=content><h1>Head {i}</h1>{body}<div>All rights kept</div></div><section class='comments'><p>me too {i}</p></section><aside>s</aside><footer>&copy; {i}</footer>"


def test_wrappers_keep_content_and_drop_templates(spark):
    pars = {i: [f"para {i} {k} with &amp; <b>bold</b>  text<br>and more" for k in range(i % 5 + 2)] for i in range(30)}
    rows = [(i, f"http://Site.example/{i}", page(i, pars[i])) for i in pars]
    rows += [(100, None, None), (101, "", ""), (102, "http://one.example/", "just text &lt;x&gt;"), (103, "http://two.example/", "<article><p>a<p>b</article>"), (103, "http://two.example/", "<article><p>a<p>b</article>"), (104, "http://deep.example/", "<div>" * 5000 + "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html.digest(df).collect()}
    for i, p in pars.items():
        assert got[i]["text"] == "\n".join([f"Head {i}", *(f"para {i} {k} with & bold text and more" for k in range(len(p)))])
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"] == "just text <x>" and got[103]["text"] == "a\nb" and got[104]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and html.digest(df).count() == len(rows)
    assert html.digest(df.limit(0)).count() == 0


def site(spark, pages, host="h.example"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html.digest(df).collect()}


def test_every_varying_slot_stays(spark):
    long = lambda i: f"body {i} " + "with many words " * 20
    post = lambda i: f"<body><div class=post><div class=head><h2>Title {i}</h2><p>Lead {i}</p></div><div class=body><p>{long(i)}</p></div></div>"
    two = lambda i: f"<body><div class=one><p>{long(i)}</p></div><div class=two><p>second {i} {'of words ' * 12}</p></div>"
    got = site(spark, [post(i) for i in range(9)])
    assert all(got[i] == f"Title {i}\nLead {i}\n{long(i).strip()}" for i in got)
    got = site(spark, [two(i) for i in range(8)] + [post(8)])
    assert all(f"second {i} " in got[i] and f"body {i} " in got[i] for i in range(8)) and "Lead 8" in got[8]


def test_two_pages_have_a_template_and_long_lists_are_aligned(spark):
    body = lambda i, n: "".join(f"<p>story {i} says {k}</p>" for k in range(n))
    make = lambda i, n: f"<body><div class=post><h1>Head {i}</h1>{body(i, n)}<p>Sign the letter</p>{body(-i, n // 2)}</div><div>Made with care</div>"
    for sizes in ((3, 5), (20, 31), (700, 40, 1500)):
        got = site(spark, [make(i + 1, n) for i, n in enumerate(sizes)])
        for i, n in enumerate(sizes):
            want = [f"Head {i + 1}", *(f"story {i + 1} says {k}" for k in range(n)), *(f"story {-i - 1} says {k}" for k in range(n // 2))]
            assert got[i].split("\n") == want


def test_copies_of_a_page_are_no_template(spark):
    article = "<body><div class=post><h1>One</h1><p>first long text</p><p>second long text</p></div><div>Made with care</div>"
    other = "<body><div class=post><h1>Two</h1><p>another text</p></div><div>Made with care</div>"
    mirrored = site(spark, [article + f"<!-- {i} --><script>{i}</script>" for i in range(9)])
    assert set(mirrored.values()) == {"One\nfirst long text\nsecond long text\nMade with care"}
    mixed = site(spark, [article + f"<nav>{i}</nav>" for i in range(40)] + [other])
    assert {mixed[i] for i in range(40)} == {"One\nfirst long text\nsecond long text"} and mixed[40] == "Two\nanother text"


def test_the_wrapper_decides(spark):
    """Menus, adverts and footers of any mark-up go where they are constant; without its wrapper no page is right."""
    untagged = lambda i: f"<body><div><span>Home</span> <span>News</span></div><div class=lead>Buy our tea</div><div class=x><h1>Head {i}</h1><p>story {i} with words</p></div><div>All rights kept</div>"
    for n in range(1, 13):
        pages = [untagged(i) for i in range(n)]
        got = site(spark, pages, f"h{n}.example") if n in (1, 2, 3, 12) else {}
        for i, text in got.items():
            want = f"Head {i}\nstory {i} with words"
            assert text == (want if n > 1 else f"Home News\nBuy our tea\n{want}\nAll rights kept")
    tagged = lambda i: f"<body><nav>Home News</nav><div class=ad>Buy tea {i}</div><p>story {i}</p><footer>All rights kept</footer>"
    got = site(spark, [tagged(i) for i in range(4)])
    assert got == {i: f"story {i}" for i in range(4)}
    empty = {"template": [], "regions": []}
    assert all(html.extract(tagged(i), empty) != got[i] for i in got)


def test_pages_with_long_templates_and_short_texts(spark):
    """Much constant text in marked regions makes no near copies; a varying region goes whole, with its constant parts."""
    menu = "".join(f"<li>entry number {k}</li>" for k in range(60))
    make = lambda i: f"<body><nav><ul>{menu}</ul></nav><p>tale {i}</p><section class=comments><h3>Comments</h3><p>nice {i}</p></section>"
    assert site(spark, [make(i) for i in range(5)]) == {i: f"tale {i}" for i in range(5)}


def test_equal_headings_of_articles_stay(spark):
    make = lambda i: f"<body><div>Menu of all</div><article><h1>Head {i}</h1><h2>Introduction</h2><p>story {i} begins</p><h2>References</h2></article><div>Made with care</div>"
    assert site(spark, [make(i) for i in range(2)]) == {i: f"Head {i}\nIntroduction\nstory {i} begins\nReferences" for i in range(2)}
    loose = lambda i: f"<body><h1>The site</h1><div>Menu of all</div><div class=post><h2>Head {i}</h2><h3>Abstract</h3><h4>In short</h4><p>story {i}</p><h3>Closing</h3><p>Write to us</p></div>"
    assert site(spark, [loose(i) for i in range(5)]) == {i: f"Head {i}\nAbstract\nIn short\nstory {i}" for i in range(5)}


@pytest.mark.parametrize("words", [1, 5, 60, 500])
def test_much_template_is_template_beside_stories_of_any_length(spark, words):
    lines = "".join(f"<div>constant line {k} of this site</div>" for k in range(12))
    make = lambda i: f"<body>{lines}<p>{' '.join(f'story{i}x{k}' for k in range(words))}</p>"
    assert site(spark, [make(i) for i in range(5)]) == {i: " ".join(f"story{i}x{k}" for k in range(words)) for i in range(5)}


def test_near_copies_of_an_article_keep_it(spark):
    make = lambda i: "<body><div class=post><h1>One head</h1>" + "".join(f"<p>paragraph {k}{' edited' * (k == i)}</p>" for k in range(12)) + "</div>"
    got = site(spark, [make(i) for i in range(6)] + ["<body><div class=post><h1>Another</h1><p>text</p></div>"])
    assert all(got[i].split("\n") == ["One head", *(f"paragraph {k}{' edited' * (k == i)}" for k in range(12))] for i in range(6)) and got[6] == "Another\ntext"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_the_table_of_pages_is_read_as_by_a_plain_extractor(spark):
    """Its articles are in an element of that name; whatever stands in it outside forms, menus and the like is the text."""
    import re
    from html import unescape

    def plain(page):
        body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        body = re.sub(r"(?s)<(script|style|form|aside|nav)\b.*?</\1>|<!--.*?-->|<br\s*/?>", " ", body)
        parts = re.split(r"<[^>]+>", re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", body))
        return "\n".join(t for x in parts if (t := " ".join(unescape(x).split())))

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.digest(rows).collect()}
    assert got == {r["page_id"]: plain(r["html"]) for r in rows.collect()}


def test_tree_matching_aligns_children_in_order():
    a, b = html.parse("<div><p>1</p><h2>x</h2><p>2</p></div>"), html.parse("<div><p>1</p><p>3</p></div>")
    size, pairs = html.match(a, b)
    assert size == 4 and len(pairs) == 4


# ---- registry and pipeline ---------------------------------------------------------


def test_registry():
    names = queries.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    r = random.Random(2)
    words = {"en": "the of and to in".split(), "de": "der die und zu ein".split()}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        text = " ".join(r.choice(words[lang]) + r.choice(["", "er", "st", "ung"]) for _ in range(60))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(100, rows[0][1], "de", "s0", rows[0][4]), (101, "12 34", "en", "s1", 5), (102, rows[1][1] + " a@b.de", "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "pii", "mix_sources", "packing"]
    clash = docs.withColumns({c: F.lit(1) for c in ("row", "node", "score", "lang_pred", "rejected", "mix_note", "mix_size", "pii", "shard", "key")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns and dict(out.dtypes) == dict(clash.dtypes)
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids and 100 not in ids and 101 not in ids and 102 not in ids
