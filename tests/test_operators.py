"""Operators and functions on rows made by hand; expected values follow from the stated rules."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom import queries
from paperloom.functions import text as tx
from paperloom.functions import venue
from paperloom.operators import board, lineage, log, mart, resolve, retrieval, trends, verify
from paperloom.plans import search
from paperloom.sources import io
from paperloom.streaming import incremental
from tests import oracle, test_fulltext


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- functions -----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("8 pages, accepted to CVPR 2024 (Highlight)", ("CVPR", 2024, "main")),
        ("submitted to ICRA 2023", None),
        ("Submitted to ICRA 2023, accepted", ("ICRA", 2023, "main")),
        ("Extension of our CVPR 2022 paper", None),
        ("2023 IEEE International Conference on Robotics and Automation", ("ICRA", 2023, "main")),
        ("NeurIPS'21 workshop on agents", ("NeurIPS", 2021, "workshop")),
        ("Findings of EMNLP 2022", ("EMNLP", 2022, "findings")),
        ("ICRA workshop. Published at CoRL 2020", ("CoRL", 2020, "main")),
        ("IEEE Robotics and Automation Letters", ("RA-L", None, "main")),
        ("VCORLX", None),
        (None, None),
    ],
)
def test_venues(spark, text, want):
    got = one(spark, venue.parse_venue(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("q", "want"),
    [("after 2023", (2024, 9999)), ("since 2024", (2024, 9999)), ("before 2020", (0, 2019)), ("in 2025", (2025, 2025)), ("2021-2019", (2019, 2021)), ("until 2019", (0, 2019)), ("post-2020 work", (2021, 9999)), ("no year", (None, None))],
)
def test_years_of_questions(spark, q, want):
    assert tuple(one(spark, tx.year_bounds(F.lit(q)))) == want


def test_small_functions(spark):
    assert one(spark, tx.norm_title(F.lit("A (New) Title-2!"))) == "anewtitle2"
    assert one(spark, tx.ascii_fold(F.lit("Müller Ångström"))) == "Muller Angstrom"
    assert one(spark, tx.surnames(F.array(F.lit("Ann Lee"), F.lit("Bo van Dyk"), F.lit("Cy Lee"), F.lit("?")))) == ["lee", "dyk"]
    assert one(spark, tx.key_base(F.lit("Jo Lee"), F.lit(2020), F.lit("The Art of Maps"))) == "lee2020art"
    assert one(spark, tx.key_base(F.lit(None).cast("string"), F.lit(0), F.lit("?"))) == "anonpaper"
    assert one(spark, tx.csv_cell(F.lit('a "b"'))) == '"a ""b"""'
    assert one(spark, tx.label(F.lit("Foo"), F.lit("Foo: a thing"))) == "Foo: a thing"
    assert one(spark, tx.label(F.lit("Foo"), F.lit("A thing"))) == "Foo: A thing"
    assert one(spark, tx.strip_other(F.lit("other: X"))) == "X"
    assert one(spark, tx.percent(F.lit("SR"), F.lit("0.53"))) == pytest.approx(53.0) and one(spark, tx.percent(F.lit("SR"), F.lit("n/a"))) is None
    assert [one(spark, tx.metric_cell(F.lit(m), F.lit(v))) for m, v in (("SR", "0.401"), ("NE", "5"), ("X", "0.25"), ("X", "12"), ("X", "a_b"))] == ["40.1", "5.00", "0.25", "12.0", "a\\_b"]
    assert one(spark, tx.from_positions(F.from_json(F.lit('{"b":[1,3],"a":[0,2]}'), "map<string,array<int>>"))) == "a b a b"
    assert one(spark, tx.highlight(F.lit("Big map"), ["map"])) == "Big <mark>map</mark>"
    assert one(spark, tx.arxiv_id(F.lit("https://arxiv.org/abs/2101.00001v2"))) == "2101.00001"
    assert one(spark, tx.company_badge(F.array(*map(F.lit, "abcd")))) == "a · b +2"
    assert one(spark, tx.cited_ids(F.lit("see [b] and [a], [b] [z]"), F.array(F.lit("a"), F.lit("b")))) == ["b", "a"]
    assert one(spark, tx.json_array(F.lit('Sure: [{"i": 1}] done'), "array<struct<i:int>>")) == [(1,)]
    assert one(spark, venue.venue_short(F.lit("IEEE Transactions on Neural Networks"), F.lit("other"), F.lit("x 2021"), F.lit(2020))) == "IEEE Trans. Neural Netw.'21"
    assert one(spark, venue.venue_short(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(""), F.lit(2020))) == "arXiv'20"
    assert one(spark, venue.venue_year(F.lit("CVPR"), *[F.lit(None).cast("string")] * 2, *[F.lit(None).cast("int")] * 2, F.lit("2022-11-20"), F.lit(2000))) == 2023


def test_functions_with_stacks():
    raw = "@Article{x, title={A, {B} c}, year = 2020, url={u}}"
    assert tx.tidy_bib_entry(raw, "k") == "@article{k,\n  title     = {A, {B} c},\n  year      = 2020\n}"
    assert tx.tidy_bib_entry("plain", "k") == "plain"
    assert tx.protected("A study of BERT and {VLN}") == "A study of {BERT} and {VLN}"
    assert tx.backbone("gpt-4o (frozen) + CLIP, extra") == "GPT-4o + CLIP" and tx.backbone("not stated") == ""
    assert tx.backbone("DUET pretrained on a very large corpus of houses") == "DUET"
    assert tx.companies_in("Ann, Google DeepMind", [("Google", "Google")]) == ["Google"]
    assert tx.companies_in("supported by a gift from Google", [("Google", "Google")]) == []
    assert "Lab X" in tx.author_block("\\begin{document}\\title{T {a}}\\author{Bo {Lab X}}\\begin{abstract}z", "latex")


def test_main_file(spark):
    files = {"main.tex": "\\documentclass{a}\\title{Maps}\\input{sec/a}" + "x" * 3000, "sec/a.tex": "BODY \\input{b} \\input{a} \\input{gone}", "sec/b.tex": "DEEP \\import{../}{part}", "part.tex": "\\documentclass{a}\\begin{document}PART\\end{document} no", "response.tex": "\\documentclass{a}" + "y" * 9000}
    rows = [("p", n, t, "Maps") for n, t in files.items()] + [("q", "only.tex", "\\documentclass{a} short", "Maps"), ("r", "loop.tex", "\\documentclass{a}" + "z" * 3000 + "\\input{two}", "T"), ("r", "two.tex", "2\\input{three}", "T"), ("r", "three.tex", "3\\input{two}", "T")]
    got = {r["uid"]: r["text"] for r in io.main_files(spark.createDataFrame(rows, "uid string, name string, text string, title string")).collect()}
    flat = got["p"]
    assert "BODY \nDEEP \nPART\n" in flat and "yyy" not in flat and "no" not in flat and flat.count("BODY") == 1
    assert "q" not in got and got["r"].endswith("z" + "\n2\n3" * 4 + "\n" * 10)  # eight levels, and what the ninth leaves


def test_flat_files_are_dealt_out_by_the_size_of_their_texts(spark, monkeypatch):
    monkeypatch.setattr(io, "TASK_BYTES", 100_000)
    text = F.when(F.col("k") == 0, F.concat(F.lit("\\documentclass{a}\\begin{document}\\input{b}"), F.repeat(F.lit("x"), F.lit(3000)))).otherwise(F.repeat(F.lit("y"), F.lit(2000)))
    rows = spark.range(200).select(F.col("id").alias("uid"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).select("uid", F.when(F.col("k") == 0, "a.tex").otherwise("b.tex").alias("name"), text.alias("text"), F.lit("T").alias("title"))
    flat = io.flat_files(rows, "title").cache()
    assert flat.count() == 200 and {(len(r["flat"]), r["title"]) for r in flat.collect()} == {(33 + 1 + 2000 + 1 + 3000, "T")}
    # repetitive texts shuffle to next to nothing; each task has about 100,000 bytes of them all the same
    most = flat.groupBy(F.spark_partition_id()).agg(F.sum(F.length("flat")).alias("n")).agg(F.max("n")).first()[0]
    assert flat.rdd.getNumPartitions() >= 10 and most < 300_000


# ---- search ----------------------------------------------------------------------------


def test_grammar():
    q = search.parse('task:VLN year:>=2024 -exclude "exact phrase" foo:bar -x:y -venue:cvpr')
    assert q.terms == ("exact phrase", "foo:bar") and q.without == ("exclude", "y")
    assert q.fields == (("tk", "vln", False), ("y", ">=2024", False), ("v", "cvpr", True))
    spec = search.from_state("q=maps&tk=A,B&sc=any&sort=old", ["sc", "tk"])
    assert spec.selected == {"tk": ["A", "B"], "sc": []} and spec.sort == "old"
    assert search.to_state(spec, "maps") == "q=maps&tk=A%2CB&sc=any&sort=old"


def test_junk_years_hold_and_their_negation_rejects_all(spark):
    df = spark.createDataFrame([(2020, "a")], "y int, _h string")
    assert df.where(search.matches(df, search.parse("year:junk"))).count() == 1
    assert df.where(search.matches(df, search.parse("-year:junk"))).count() == 0


def test_facet_counts_leave_their_own_selection_out(spark):
    df = spark.createDataFrame([(1, "core", ["x", "x"]), (2, "core", ["y"]), (3, "out", ["x"])], "id int, sc string, tk array<string>").withColumn("_h", F.lit(""))
    facets = [search.Facet("sc", search.scalar("sc")), search.Facet("tk", search.many("tk"))]
    got = {(r["facet"], r["value"]): r["n"] for r in search.facet_counts(df, facets, search.Spec(selected={"sc": ["core"], "tk": ["x"]})).collect()}
    assert got == {("sc", "core"): 1, ("sc", "out"): 1, ("tk", "x"): 1, ("tk", "y"): 1}


# ---- logs --------------------------------------------------------------------------------


def test_upsert_keeps_first_sight_and_the_last_of_the_highest_version(spark):
    schema = "id string, version int, title string, queries array<string>, first_seen string"
    state = spark.createDataFrame([("a", 1, "old", ["q1"], "2020")], schema)
    batch = spark.createDataFrame([("a", 2, "new", ["q2"], "2021", 1), ("a", 1, "late", ["q3"], "2022", 2), ("a", 2, "newest", ["q2"], "2023", 3), ("b", 1, "b", ["q1"], "2021", 4)], schema + ", _seq long")
    once = log.upsert(state, batch, ["title"])
    rows = {r["id"]: r for r in once.collect()}
    assert (rows["a"]["title"], rows["a"]["version"], rows["a"]["first_seen"]) == ("newest", 2, "2020") and rows["a"]["queries"] == ["q1", "q2", "q3"]
    again = {r["id"]: r for r in log.upsert(once, batch, ["title"]).collect()}
    assert again["a"] == rows["a"] and again["b"] == rows["b"]


def test_stream_of_upserts_is_the_batch(spark, tmp_path):
    schema = "id string, version int, title string, queries array<string>, first_seen string, _seq long"
    rows = [("a", 1, "t1", ["x"], "2020", 1), ("b", 1, "t2", ["x"], "2020", 2), ("a", 2, "t3", ["y"], "2021", 3), ("a", 1, "t4", ["z"], "2022", 4)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = incremental.folder_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    incremental.upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", ["title"]).awaitTermination()
    state = incremental.read_state(spark, f"{tmp_path}/out", schema.removesuffix(", _seq long"))
    got = {r["id"]: (r["version"], r["title"], sorted(r["queries"])) for r in state.collect()}
    assert got == {"a": (2, "t3", ["x", "y", "z"]), "b": (1, "t2", ["x"])}


def test_stream_of_sliding_counts_is_the_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 0{i % 8}:{(7 * i) % 60:02d}:00") for i in range(60)]
    events = spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/e")
    q = incremental.sliding_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), "user_id").writeStream.format("memory").queryName("sliding").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("sliding").collect())) == sorted(map(tuple, incremental.sliding_counts(events, "user_id").collect()))


def test_labels_overrides_and_marks(spark):
    labels = spark.createDataFrame([("a", "core", ["T1", "bad", "T1"], "harness"), ("b", "zzz", [], "x"), ("c", "out", None, "p1")], "uid string, scope string, tasks array<string>, paradigm string")
    codes = {"scope": ["core", "out"], "tasks": ["T1"], "paradigm": ["p1", "agentic"]}
    got = {r["uid"]: r for r in log.validate_labels(labels, codes, ["tasks"], {"paradigm": "p1"}, {"harness": "agentic"}).collect()}
    assert set(got) == {"a", "c"} and got["a"]["tasks"] == ["T1", "T1"] and got["a"]["paradigm"] == "agentic" and got["c"]["tasks"] == []
    over = spark.createDataFrame([("a", {"scope": None}), ("c", {"paradigm": "q"})], "uid string, set map<string,string>")
    done = {r["uid"]: r for r in log.override(labels, over, "uid", ["scope", "paradigm"]).collect()}
    assert done["a"]["scope"] is None and done["a"]["paradigm"] == "harness" and done["c"]["paradigm"] == "q" and done["b"]["override"] is False
    updates = spark.createDataFrame([("a", True, "", "", 1), ("a", False, "", "", 2), ("b", False, "todo", "", 3)], "uid string, star boolean, status string, note string, _seq long")
    assert [r["uid"] for r in log.marks(updates).collect()] == ["b"]


def test_rolling_window_is_strict(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:59:59"), (1, "2024-01-01 01:00:00")], "u int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r["recent"] for r in log.rolling_counts(e, "u", "ts", 3600).orderBy("t").collect()] == [0, 1, 1]


def test_the_window_of_all_crosses_midnight(spark):
    e = spark.createDataFrame([("2024-01-01 23:59:00",), ("2024-01-02 00:01:00",), ("2024-01-02 23:59:00",), ("2024-01-02 23:59:00",), ("2024-01-09 00:00:00",)], "t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r["recent"] for r in log.rolling_counts(e, None, "ts", 86400).orderBy("t").collect()] == [0, 1, 2, 2, 0]


def test_rolling_counts_are_those_of_brute_force(spark):
    import random

    r = random.Random(3)
    at = sorted(r.randrange(0, 40_000) for _ in range(300))
    e = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(at)], "i int, u int, s long").withColumn("ts", F.timestamp_seconds("s"))
    for who in ("u", None):
        for seconds in (1, 7, 600, 3600):
            want = [sum(t - seconds < x <= t and (who is None or j % 3 == i % 3) for j, x in enumerate(at)) - 1 for i, t in enumerate(at)]
            assert [x["recent"] for x in log.rolling_counts(e, who, "ts", seconds).orderBy("i").collect()] == want


def test_notes_to_read_again_and_to_share(spark):
    s = "uid string, version string, source string, read_at string, shared_from string, abstract_reason string, arxiv_id string"
    notes = spark.createDataFrame([("a", "v2", "latex", "2024", None, None, "1"), ("b", "v1", "latex", "2024", None, None, None), ("c", "v2", "abstract", "2023", None, "x", None), ("d", "v2", "latex", "2024", "other", None, None)], s)
    links = spark.createDataFrame([("c", "2024")], "uid string, at string")
    assert sorted(r["uid"] for r in log.to_read_again(notes, links, "v2").collect()) == ["b", "c", "d"]
    theirs = spark.createDataFrame([("a", "v3", "2025"), ("d", "v3", "2025"), ("e", "v1", "2020")], "uid string, version string, read_at string")
    assert sorted(r["uid"] for r in log.shared_notes(notes, theirs).collect()) == ["d", "e"]


# ---- resolution ----------------------------------------------------------------------------


def test_fold(spark):
    arx = spark.createDataFrame([("1", "Title A", 1), ("2", "Same", 2), ("3", "same!", 3)], "arxiv_id string, title string, _seq long")
    oa = spark.createDataFrame([("o1", "1", "other", 1), ("o2", None, "title a", 2), ("o3", None, "SAME", 3), ("o4", None, "New one", 4), ("o5", None, "new-one", 5), ("o6", None, "!!", 6), ("o7", None, "??", 7)], "oa_id string, arxiv_id string, title string, _seq long")
    got = {r["oa_id"]: r["uid"] for r in resolve.fold(arx, oa).collect()}
    assert got == {"o1": "1", "o2": "1", "o3": "3", "o4": "oa:o4", "o5": "oa:o4", "o6": "oa:o6", "o7": "oa:o6"}


FUZZY = "uid string, arxiv_id string, linked string, name string, title string, year int, authors array<string>, _seq long"


def brute_duplicates(rows):
    """The rule, pair by pair."""
    import re
    from difflib import SequenceMatcher

    last = lambda a: re.sub("[^a-z]", "", a.split()[-1].lower())
    keep, out = [r for r in rows if r[1]], {}
    for uid, ax, linked, name, title, year, authors, _ in rows:
        if ax:
            continue
        if linked and any(k[1] == linked for k in keep):
            out[uid] = [k[0] for k in keep if k[1] == linked][-1]
            continue
        n = (name or "").lower().strip()
        pool = [k for k in keep if len(n) >= 3 and (k[3] or "").lower().strip() == n]
        plain = lambda x: re.sub("[^a-z0-9 ]", "", x.lower())
        pool = pool or [k for k in keep if abs((k[5] or 0) - (year or 0)) <= 2 and SequenceMatcher(None, plain(title), plain(k[4])).ratio() > 0.9]
        for k in pool:
            la, lb = {last(a) for a in authors} - {""}, {last(a) for a in k[6]} - {""}
            first = bool(authors and k[6]) and last(authors[0]) == last(k[6][0])
            if abs((k[5] or 0) - (year or 0)) <= 2 and (len(la & lb) >= 2 or first):
                out[uid] = k[0]
                break
    return out


def test_fuzzy_duplicates(spark):
    long = "vision and language navigation with very long memory of rooms"
    rows = [
        ("a", "1", None, "", long, 2020, ["A Lee", "B Kim"], 1),
        ("a2", "2", None, "", long + "!", 2021, ["A Lee"], 2),
        ("b", None, None, "", long + "s", 2021, ["Q Lee", "B Zhu"], 3),  # same first author, titles alike: the first keeper
        ("c", None, None, "", long + "s", 2023, ["A Lee"], 4),  # three years after a, two after a2
        ("d", None, None, "", long, 2020, ["C Oda", "B Kim"], 5),  # one surname in common, another first
        ("e", "3", None, "NavX", "something else", 2020, ["B Kim", "A Lee"], 6),
        ("f", None, None, " navx", "a new title", 2020, ["Z Zhu", "A Lee", "B Kim"], 7),  # same name, two surnames
        ("g", "4", None, "", long, 2020, [], 8),
        ("h", None, None, "", long, 2020, [], 9),  # no authors on either side share none
        ("i", None, "4", "x", "linked to g", 1900, [], 10),
        ("j", None, None, "", long, None, ["A Lee"], 11),  # an unknown year is 0
        ("k", "5", None, "", long + "?", None, ["A Lee"], 12),
        ("l", None, None, "NavX", long, 2020, ["A Lee"], 13),  # its namesake is no match, so titles are not looked at
        ("m", "6", None, "", "titles of rooms", 2001, ["??", "X Ya"], 14),
        ("n", None, None, "", "titles of rooms", 2001, ["!!"], 15),  # first authors without letters are alike
    ]
    got = {r["dup"]: r["keeper"] for r in resolve.fuzzy_duplicates(spark.createDataFrame(rows, FUZZY)).collect()}
    assert got == brute_duplicates(rows) == {"b": "a", "c": "a2", "f": "e", "i": "g", "j": "k", "n": "m"}


def test_fuzzy_duplicates_of_one_common_surname(spark):
    """Many rows of one first author: what the ratio's bounds rule out is never compared, and the result is the rule's."""
    import random

    r = random.Random(4)
    words = [a + b for a in ("map", "nav", "rob", "vis", "lan", "mem") for b in ("s", "ing", "ot", "ion", "ory", "er")]
    rows = []
    for i in range(240):
        title = " ".join(r.choice(words) for _ in range(r.randint(3, 9))) if i % 6 or not rows else rows[r.randrange(len(rows))][4] + r.choice(["", "s", "!"])
        rows.append((f"u{i}", f"x{i}" if i % 2 else None, None, "", title, 2000 + i % 4, ["W Wang", f"X {r.choice('abcdef') * 3}"], i))
    got = {x["dup"]: x["keeper"] for x in resolve.fuzzy_duplicates(spark.createDataFrame(rows, FUZZY)).collect()}
    want = brute_duplicates(rows)
    assert got == want and len(want) >= 5


def test_fuzzy_duplicates_query_compares_whole_titles(spark, tmp_path):
    from paperloom import queries

    opening = "a shared opening of many plain words " * 5
    titles = [opening + "cats", opening + "cats", opening + " ".join(f"dog{i}" for i in range(60)), "x" * 10 + opening + "cats", *(f"{a} {b}" for a in ("large", "hot", "hots") for b in ("ring", "rings", "bolt"))]
    parts = [(i, n, f"Brand#{i % 2}", "LARGE" if i % 3 else "SMALL", 10 + i % 5) for i, n in enumerate(titles * 3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    letters = str.maketrans("#0123456789", "kabcdefghij")
    rows = [(i, f"x{i}" if i % 2 == 0 else None, "x2" if i % 97 == 1 else None, n if i % 5 == 0 else None, n, z, [b.translate(letters), k.translate(letters)], i) for i, n, b, k, z in parts]
    assert {r["dup"]: r["keeper"] for r in queries.queries()["fuzzy_duplicates"](spark, str(tmp_path)).collect()} == brute_duplicates(rows)


def test_twins_by_title(spark):
    index = spark.createDataFrame([("A Map of the Rooms!", "p1"), ("maps of many rooms and doors", "p2"), ("maps of many rooms and door", "p3"), ("other", "p4")], "title string, found string")
    papers = spark.createDataFrame([("a", "a map of the rooms"), ("b", "Maps of many rooms and doorss"), ("c", "nothing alike"), ("d", "")], "uid string, title string")
    got = {r["uid"]: (r["found"], r["exact"]) for r in resolve.twin_by_title(papers, index).collect()}
    assert got == {"a": ("p1", True), "b": ("p2", False)}


def test_prefilter_order(spark):
    s = "queries array<string>, title string, abstract string, oa_type string, arxiv_id string, categories array<string>, year int"
    rows = [(["seed"], "", "", None, None, [], 1990), (["q"], "", "nav", None, "1", ["cs.RO"], 2020), (["q"], "x", "", None, "1", ["cs.RO"], 2020), (["q"], "nav", "", "dataset", "1", ["cs.RO"], 2020), (["q"], "nav", "", None, None, [], 2020), (["q"], "nav", "", None, "1", ["math.X"], 2020), (["q"], "nav vln", "", None, None, [], 2010), (["q"], "nav", "a", None, "1", ["cs.RO"], 2010), (["q"], "nav", "a", None, "1", ["cs.RO"], 0)]
    text = F.concat_ws(" ", "title", "abstract")
    df = spark.createDataFrame(rows, s).select(resolve.prefilter(text.rlike("nav"), text.rlike("vln"), F.exists("categories", lambda c: c.startswith("cs.")), 2016).alias("p"))
    assert [r["p"] for r in df.collect()] == ["keep", "drop:no-title", "drop:no-term", "drop:type", "drop:oa-weak", "drop:category", "drop:old-no-abstract", "drop:pre-2016", "keep"]


# ---- the board -------------------------------------------------------------------------------


@pytest.mark.parametrize("audit", [True, False, None])
@pytest.mark.parametrize("cmp", [True, False, None])
@pytest.mark.parametrize(("priv", "said"), [("uses oracle", True), ("no ground-truth maps used", False), ("None; oracle", False), (None, False)])
def test_verdict_table(spark, audit, cmp, priv, said):
    want = (not audit) if audit is not None else (not cmp) if cmp is not None else said
    b = lambda v: F.lit(v).cast("boolean")
    assert one(spark, board.nonstandard(b(audit), b(cmp), F.lit(priv).cast("string"), F.lit(None).cast("string"))) is want


def test_metrics(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    assert one(spark, board.consistent(m(SR="50", SPL="50.04"))) and not one(spark, board.consistent(m(SR="50", SPL="50.06")))
    assert one(spark, board.consistent(m(SR="0.5", SPL="n/a"))) and not one(spark, board.consistent(m(SR="0.5", OSR="0.4")))
    assert one(spark, board.rename_metrics(m(sr="1"), {"sr": "SR"})) == {"SR": "1"} and one(spark, board.rename_metrics(m(sr="1", SR="2"), {"sr": "SR"})) == {"sr": "1", "SR": "2"}
    rows = spark.createDataFrame([(1, {"SR": "0.53"}), (2, {"SR": "9.99"}), (3, {})], "id int, m map<string,string>")
    texts = spark.createDataFrame([(1, "we reach \\bf53.0 and 0.53"), (2, "none 1999"), (3, "")], "id int, text string")
    assert {r["id"]: r["verified"] for r in verify.verify_numbers(rows, texts).collect()} == {1: True, 2: False, 3: None}


def test_records_and_numbers(spark):
    df = spark.createDataFrame([("b", 1, 5.0), ("b", 2, 4.0), ("b", 3, 7.0), ("b", 4, 7.0)], "g string, t int, v double")
    assert [r["t"] for r in board.records(df, ["g"], [F.col("t")], "v").orderBy("t").collect()] == [1, 3]
    assert [r["t"] for r in board.records(df, ["g"], [F.col("t")], "v", higher=False).orderBy("t").collect()] == [1, 2]
    notes = spark.createDataFrame([("p", [("other: X", {"sr": "1"}), ("Y", {})])], "uid string, numbers array<struct<bench:string,metrics:map<string,string>>>")
    papers = spark.createDataFrame([("p", 2020)], "id string, y int")
    got = board.explode_numbers(notes, papers, metric_alias={"sr": "SR"}).collect()
    assert len(got) == 1 and got[0]["bench"] == "X" and got[0]["metrics"] == {"SR": "1"}


# ---- mart, trends, retrieval, lineage -----------------------------------------------------------


def test_cite_keys(spark):
    rows = [(i, ["Jo Lee"], 2020, "The Maps") for i in range(3)] + [(9, [], 0, "?")]
    got = [r["key"] for r in mart.cite_keys(spark.createDataFrame(rows, "_seq long, a array<string>, y int, t string")).orderBy("_seq").collect()]
    assert got == ["lee2020maps", "lee2020mapsb", "lee2020mapsc", "anonpaper"]


def test_cite_keys_of_a_hot_base(spark):
    rows = [(i, ["Jo Lee"], 2020, "The Maps") for i in range(700)]
    got = [r["key"] for r in mart.cite_keys(spark.createDataFrame(rows, "_seq long, a array<string>, y int, t string")).orderBy("_seq").collect()]
    assert len(set(got)) == 700 and got[25:27] == ["lee2020mapsz", "lee2020maps-27"] and got[699] == "lee2020maps-700"


def test_a_suffixed_key_is_no_other_base(spark):
    rows = [(i, ["Jo Lee"], 2020, "The Map") for i in range(3)] + [(9, ["Jo Lee"], 2020, "Mapb")]
    got = [r["key"] for r in mart.cite_keys(spark.createDataFrame(rows, "_seq long, a array<string>, y int, t string")).orderBy("_seq").collect()]
    assert got == ["lee2020map", "lee2020mapc", "lee2020mapd", "lee2020mapb"]


def test_margins_count_papers_once(spark):
    p = spark.createDataFrame([(1, ["A", "B"], "x"), (2, ["A"], "y")], "id int, tk array<string>, pd string")
    got = {(r["task"], r["paradigm"]): r["n"] for r in trends.map_counts(p).collect()}
    assert got[(None, None)] == 2 and got[(None, "x")] == 1 and got[("A", None)] == 2 and got[("B", "x")] == 1


def test_bm25_and_pins(spark):
    docs = spark.createDataFrame([(1, "NavX", "maps of rooms", 5, "core", 2020), (2, "Foo", "maps", 0, "core", 2021), (3, "Bar", "other", 0, "out", 2022)], "id int, n string, t string, c int, sc string, y int")
    got = [r["id"] for r in retrieval.retrieve(docs, "what does navx do with maps since 2021", {"n": 3.0, "t": 2.0}, low=2021).collect()]
    assert got == [1, 2]
    assert retrieval.query_terms("the vision-language maps of 2021") == ["language", "maps", "vision", "vision-language"]


def test_lineage_and_trees(spark):
    notes = spark.createDataFrame([("a", ["Foo-Net", "foonet", "Bar"], ["A"]), ("b", ["Bar"], [])], "uid string, builds_on array<string>, compares_to array<string>")
    papers = spark.createDataFrame([("a", "A"), ("f", "FooNet"), ("z", "bar")], "id string, n string")
    assert sorted(map(tuple, lineage.edges(notes, papers).collect())) == [("a", "f"), ("a", "z"), ("b", "z")]
    tree = lineage.flatten_tree(spark, [{"id": "r", "children": [{"id": "l1"}, {"id": "l2"}]}])
    assigned = spark.createDataFrame([("p", "l1"), ("q", "l1"), ("p", "l2")], "uid string, leaf string")
    assert {r["node"]: r["n"] for r in lineage.rollup(assigned, tree).collect()} == {"r": 2, "l1": 2, "l2": 1}


def test_records_without_an_id_are_no_task_of_their_own(spark, monkeypatch):
    seen, cut = {}, resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df, name: cut(seen.setdefault(name, df), name))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        harvested = spark.createDataFrame([("", "none", 1), ("a1", "One", 2)], "arxiv_id string, title string, _seq int")
        other = spark.createDataFrame([("", None, "two", 1), ("w1", "", "three", 2), ("w2", "a1", "four", 3), ("w3", None, "ONE!", 4), ("w4", None, "two.", 5)], "oa_id string, arxiv_id string, title string, _seq int")
        got = {r["oa_id"]: r["uid"] for r in resolve.fold(harvested, other).collect()}
        assert got == {"": "oa:", "w1": "oa:w1", "w2": "a1", "w3": "a1", "w4": "oa:"}
        plan = seen["records"]._jdf.queryExecution().executedPlan().toString()
        assert all("__own" in x.split(")")[0] for x in plan.split("hashpartitioning(key")[1:]) and "hashpartitioning(key" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_keys_and_signs_of_titles(spark):
    titles = ["The Art of Maps", "the-the a", "THEory", "a1 the", "", None, "?", "Zürich by night", "on_line", "How to 3D", "\u212Aelvin \U0001F600 x", "an\tandroid"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    words = F.filter(F.regexp_extract_all(F.lower("t"), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(tx.KEY_STOP))
    want = F.concat(F.lit("anon"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("paper")))
    plain = lambda signs: F.regexp_replace(F.lower("t"), signs, "")
    rows = df.select(tx.key_base(F.lit(None).cast("string"), F.lit(0), F.col("t")), want, plain(resolve._SIGNS), plain("[^a-z0-9 ]")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)
    made = mart.suffixed(spark.createDataFrame([("p1", "a", 2), ("p2", "a", 1), ("p3", "b", 3)], "id string, base string, _seq int"))
    assert {r["id"]: r["key"] for r in made.collect()} == {"p1": "ab", "p2": "a", "p3": "b"}


def test_inverted_index_is_made_in_its_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", ""]), (2, [""]), (3, None), (4, [])], "id int, w array<string>").select("id", tx.to_positions(F.col("w")).alias("x"))
    assert {r["id"]: r["x"] for r in df.collect()} == {1: {"": [3], "a": [1], "b": [0, 2]}, 2: {"": [0]}, 3: None, 4: {}}
    made = queries.queries()["inverted_index_text"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_bib_entries_of_a_batch_are_read_once(monkeypatch):
    import pandas as pd

    seen, read = [], tx.parsed_entry
    monkeypatch.setattr(tx, "parsed_entry", lambda raw: seen.append(raw) or read(raw))
    raw = pd.Series(["@a{x, title={A b}}", None, "plain"] * 50)
    tidy = tx.tidy_bib.func(raw, pd.Series([f"k{i}" for i in range(150)]))
    assert list(tidy[:3]) == ["@a{k0,\n  title     = {A b}\n}", None, "plain"] and tidy[147] == "@a{k147,\n  title     = {A b}\n}"
    assert list(tx.clean_bib.func(raw)[:3]) == ["@a{x, title = {A b}}", None, "plain"] and tx.protect_title.func(raw)[1] == ""
    assert seen.count("@a{x, title={A b}}") == 2


def test_margins_of_papers_with_several_rows(spark):
    p = spark.createDataFrame([(1, ["A", "B", "A"], "x"), (1, ["A"], "y"), (1, ["A"], "y"), (2, None, "x"), (3, ["A"], None)], "id int, tk array<string>, pd string")
    found = trends.map_counts(p)
    got = sorted(((r["task"], r["paradigm"], r["n"]) for r in found.collect()), key=str)
    assert got == sorted([("A", "x", 1), ("A", "y", 1), ("B", "x", 1), ("A", None, 1), ("A", None, 2), ("B", None, 1), (None, "x", 1), (None, "y", 1), (None, None, 1), (None, None, 2)], key=str)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each margin of each cell is kept


def test_documents_in_archives(spark, tmp_path):
    docs = spark.createDataFrame([("n1.json", '{\n "a": 1\n}'), ("n2.json", '{"a": 2'), ("n3.json", "no"), ("n4.json", "")], "name string, text string")
    packed = io.pack_documents(docs, str(tmp_path), archives=2)
    assert [(r["uid"], r["a"]) for r in io.read_packed_docs(packed, "a int").where("a is not null").collect()] == [("n1", 1)]


def test_mentions_carry_no_text(spark):
    texts = spark.createDataFrame([(1, "Big Maps of big maps"), (2, "maps"), (3, None), (4, "of bigmaps. Maps, of!")], "id int, text string")
    names = spark.createDataFrame([("big maps",), ("Maps",), ("maps of",), ("of big maps of",), ("--",)], "name string")
    found = retrieval.mentions(texts, names)
    assert sorted(map(tuple, found.collect())) == [(1, "Maps"), (1, "big maps"), (1, "maps of"), (2, "Maps"), (4, "Maps"), (4, "maps of")]
    assert retrieval.mentions(texts, names.limit(0)).count() == 0
    assert "line" not in found._jdf.queryExecution().optimizedPlan().toString()  # the row of a text's word has no copy of the text


# ---- sources and sinks ----------------------------------------------------------------------------


def test_files(spark, tmp_path):
    p = str(tmp_path)
    assert io.read_jsonl(spark, f"{p}/none.jsonl", "a int").count() == 0
    io.write_jsonl(spark.createDataFrame([(2,), (1,)], "a int"), f"{p}/t", [F.col("a")], compression="gzip")
    assert sorted(r["a"] for r in io.read_jsonl(spark, f"{p}/t", "a int").collect()) == [1, 2]
    (tmp_path / "keyed.json").write_text('{"k1": {"ok": true}, "k2": {"ok": null}}')
    assert {r["key"]: r["value"]["ok"] for r in io.read_keyed(spark, f"{p}/keyed.json", "struct<ok:boolean>").collect()} == {"k1": True, "k2": None}
    (tmp_path / "seeds.txt").write_text("# all\n2101.1 # first\n\n2102.2\n")
    assert [r["id"] for r in io.read_seeds(spark, f"{p}/seeds.txt").collect()] == ["2101.1", "2102.2"]
    (tmp_path / "feed.xml").write_text('<feed><entry><id>http://arxiv.org/abs/2101.00001v3</id><title>A\n  B</title><summary>s</summary><published>2021-01-01T00:00:00Z</published><updated>2021-01-02T00:00:00Z</updated><author><name>Jo Lee</name></author><category term="cs.RO"/></entry></feed>')
    r = io.read_feed(spark, f"{p}/feed.xml").first()
    assert (r["id"], r["version"], r["title"], r["authors"], r["categories"]) == ("2101.00001", 3, "A B", ["Jo Lee"], ["cs.RO"])
    counts = io.snapshot({"t": spark.createDataFrame([(1, "raw")], "a int, b string"), "u": spark.range(3)}, f"{p}/snap", drop={"t": ["b"]}, skip=("u",))
    assert [tuple(x) for x in counts.collect()] == [("t", 1)] and spark.read.json(f"{p}/snap/t").columns == ["a"]
    docs = tmp_path / "notes"
    docs.mkdir()
    (docs / "n1.json").write_text('{\n "a": 1\n}')
    assert [(x["uid"], x["a"]) for x in io.read_docs(spark, str(docs), "a int").collect()] == [("n1", 1)]
    table = io.Reloading(spark, f"{p}/t", lambda s, q: s.read.schema("a int").json(q))
    assert table.get().count() == 2 and table.get() is table.get()


def test_windows_split_only_the_years_that_are_too_large(spark):
    n = spark.createDataFrame([(2018, 20), (2019, 9501), (2020, 9500)], "year int, total int")
    got = sorted((r["from"], r["to"]) for r in io.windows(n).collect())
    assert got[0] == ("2018-01-01", "2018-12-31") and got[-1] == ("2020-01-01", "2020-12-31") and len(got) == 14 and got[2] == ("2019-02-01", "2019-02-28")
    assert [tuple(r) for r in io.windows(n, 10**6).collect()] == [("2018-01-01", "2020-12-31")]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from paperloom.sources import staging

    monkeypatch.setattr(staging, "_is_local", lambda _: False)
    monkeypatch.setattr(staging, "_own_folder", [])
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            staging.shared_folder(spark)


def test_staged_tables_are_removed(spark):
    import os

    from paperloom.sources import staging

    with staging.released():
        path = staging.cut(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_accents_do_not_hide_authors(spark):
    index = spark.createDataFrame([("José Núñez", 3), ("Jos Nu", 9)], "author string, n long")
    assert [r["author"] for r in trends.autocomplete(index, "nuñ").collect()] == ["José Núñez"]


def test_domain_states_what_it_lacks():
    from paperloom.plans.domain import Domain

    assert Domain().lacks() == ["benchmarks", "categories", "paradigms", "tasks"] and Domain(scopes=("a",), tasks=(("x", "X"),)).lacks() == ["benchmarks", "categories", "paradigms", "scopes"]


def test_first_usable_and_zip(spark):
    text, source = io.first_usable(("own", F.lit("short")), ("pdf", F.lit("x" * 7000)))
    assert one(spark, source) == "pdf"
    text, source = io.first_usable(("own", F.lit(None).cast("string")), ("abstract", F.lit("short")))
    assert (one(spark, text), one(spark, source)) == ("short", "abstract")
    df = spark.createDataFrame([(["a", "b"], ["1"])], "i array<string>, r array<string>")
    assert [tuple(x) for x in io.zipped(df, "i", "r").collect()] == [("a", "1"), ("b", None)]


def test_rolling_counts_grow_with_rows_not_with_windows(spark):
    """No frame slides over a window's rows; counts are those of all pairs."""
    r = random.Random(3)
    at = [r.randint(0, 40) * 5 for _ in range(300)]
    rows = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(at)], "id int, who int, s long").withColumn("ts", F.timestamp_seconds("s"))
    for who in (None, "who"):
        got = log.rolling_counts(rows, who, "ts", 20)
        assert "RangeFrame, -" not in got._jdf.queryExecution().toString()
        want = {i: sum(0 <= t - u < 20 and (who is None or i % 2 == j % 2) for j, u in enumerate(at)) - 1 for i, t in enumerate(at)}
        assert {x["id"]: x["recent"] for x in got.collect()} == want


def _documents(spark, path, texts):
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/d")
    (file,) = (path / "d").glob("*.parquet")
    file.rename(path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", ["merge_fold_ids", "merge_fold_title"])
def test_texts_without_letters_fold_as_the_sql_says(spark, tmp_path, name):
    con = _documents(spark, tmp_path, ["…", "a", "δοκ", "", None, "...", "A!", None, "", "b", "δοκ", "B", "", None, "--", "c", "", None])
    assert oracle.mismatch(queries.queries()[name](spark, str(tmp_path)), con, queries.oracle_sql()[name]) == ""


def test_prepared_texts_at_the_edge_of_the_budget(spark, tmp_path):
    con = _documents(spark, tmp_path, ["word " * 374 + "x" * n for n in range(75)] + ["y" * n for n in range(1950, 2010)])
    assert oracle.mismatch(queries.queries()["prepared_texts"](spark, str(tmp_path)), con, queries.oracle_sql()["prepared_texts"]) == ""


def test_prepared_texts_are_of_all_documents(spark, tmp_path):
    texts = [None, None, None, "", "", "", "a", "b", "c", *("y" * n for n in range(380, 520)), *("\U0001f600" * 30 + "q" * n for n in range(400, 520)), *("\U0001f600" * n for n in range(1400, 2010, 5))]
    con = _documents(spark, tmp_path, texts)
    got = {x["doc_id"]: x["text"] for x in queries.queries()["prepared_texts"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    assert oracle.mismatch(queries.queries()["prepared_texts"](spark, str(tmp_path)), con, queries.oracle_sql()["prepared_texts"]) == ""
    tables = [f"\\begin{{tabularx}}{i}\\end{{tabularx}}" for i in range(len(texts))]
    for i, x in enumerate(texts):
        whole = x if x is None or i % 3 == 0 else f"{tables[i]}\n{x}\\appendix {tables[i]}" + " more" * 300
        assert got[i] == (None if x is None else test_fulltext.plain_prepared(whole, "latex" if i % 3 else "pdf", 2000, 500)), i


def test_sure_parts_lose_no_company():
    import re

    from paperloom.functions.companies import PATTERNS

    assert [tx.sure_part(p) for p in (r"\bNoah'?s Ark\b", r"\bHugging ?Face\b(?! (?:model|hub))", r"@a\.com", r"a|b", r"x.yz", r"(?i)ab", r"\bByte[Dd]ance\b")] == ["s Ark", "Hugging", "@a.com", "", "yz", "", "Byte"]
    r = random.Random(4)
    words = [re.sub(r"\\b|\(\?.*|\\s\*|[\\?]", "", re.sub(r"\[(.)[^\]]*\]", r"\1", p)) for _, p in PATTERNS] + ["model", "gift from", ",", "}", "\\\\", "Go", "API", "\n"]
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 8)))
        want = {n for n, p in PATTERNS if any(not re.compile(tx.SPONSOR, re.I).search(text, max(0, m.start() - 120), m.start()) for m in re.finditer(p, text, re.M))}
        assert set(tx.companies_in(text, PATTERNS)) == want
    assert sum(tx.sure_part(p) in text for _, p in PATTERNS) < len(PATTERNS) / 4


def test_feeds_are_of_bounded_size(spark, tmp_path, monkeypatch):
    from paperloom.catalogue import files

    spark.range(45_000).selectExpr("id AS o_orderkey", "'1' AS o_orderpriority", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(files, "folder", lambda *_: f"{tmp_path}/feed")
    assert queries.queries()["feed_entries"](spark, str(tmp_path)).count() == 45_000
    assert len(list((tmp_path / "feed").glob("k=*/*.txt"))) == 3


def test_equal_backbones_are_shortened_once(monkeypatch):
    asked, short = [], tx.backbone
    monkeypatch.setattr(tx, "backbone", lambda x: asked.append(x) or short(x))
    import pandas as pd

    said = pd.Series(["opus-4.5", None, "GPT-4o (frozen)", "opus-4.5", None])
    assert tx.short_backbone.func(said).tolist() == [short(x) for x in said] and len(asked) == 3


@pytest.mark.parametrize("name", ["folded_texts", "asked_in_batches"])
def test_whole_texts_reach_python_in_short_batches(spark, tmp_path, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    _documents(spark, tmp_path, ["é a"] * 30)
    before = spark.conf.get(key)
    try:
        for own, used in (("10000", "500"), ("70", "70")):
            spark.conf.set(key, own)
            assert queries.queries()[name](spark, str(tmp_path)).count() == 30 and spark.conf.get(key) == used
    finally:
        spark.conf.set(key, before)
