"""The board, surveys and answers to questions over whole tables, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import answer, board, index, log, retrieval, survey, trends
from paperloom.plans import search
from paperloom.queries import _AUTHORS, LABELS, LIBRARY, PAPERS, ROWS, _authored, facets, labels, library, papers, query, rows, t
from paperloom.sources.staging import shared_folder

# ---- board rows with verdicts: line items once more ---------------------------------------

_PLACE = ["id", "part", "supp", "line"]
_SEQ = "id * 100000000 + part * 1000 + supp"


def judged(spark, d) -> DataFrame:
    """Result rows with every field that a verdict may rest on, in an order of their own."""
    r, p = rows(spark, d), papers(spark, d).select("id", "pd", "y", "c", "date", "d")
    third = F.col("part") % 3
    m = F.create_map(F.lit("SR"), (F.col("ne") * 2).cast("string"), F.lit("SPL"), F.col("size").cast("string"))
    return r.join(p, "id").withColumns(
        {
            "_seq": F.col("id") * 100000000 + F.col("part") * 1000 + F.col("supp"),
            "m": m,
            "ok": F.when(third == 0, True).when(third == 1, False),
            "audit_ok": F.when(F.col("part") % 7 == 0, False).when(F.col("part") % 7 < 4, True),
            "audit_std": F.when(F.col("supp") % 5 == 0, False).when(F.col("supp") % 5 == 1, True),
            "audit_note": F.when(F.col("supp") % 10 == 0, "a subset of it"),
            "cmp": F.when(F.col("size") > 45, False),
            "priv": F.when(F.col("size") < 3, "oracle maps").otherwise(""),
            "extra": F.lit(""),
            "protocol": F.when(F.col("part") % 4 == 0, "100-ep"),
            "zs": F.when(F.col("part") % 2 == 0, True),
            "open": F.when(third == 0, True).when(third == 1, False),
            "note": F.when(F.col("part") % 2 == 0, "val v1").when(F.col("part") % 3 == 0, "split v2"),
        }
    )


JUDGED = f"""{ROWS}, {PAPERS}, j0 AS (SELECT r.*, p.pd, p.y, p.c, p.d, {_SEQ.replace('id', 'r.id')} AS seq, ne * 2 AS srv, CASE size WHEN 1 THEN 100 ELSE size END AS splv,
  CASE part % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok, CASE WHEN part % 7 = 0 THEN false WHEN part % 7 < 4 THEN true END AS audit_ok,
  CASE supp % 5 WHEN 0 THEN false WHEN 1 THEN true END AS audit_std, supp % 10 = 0 AS subset_note, CASE WHEN size > 45 THEN false END AS cmp, CASE WHEN size < 3 THEN 'oracle maps' ELSE '' END AS priv,
  CASE WHEN part % 4 = 0 THEN '100-ep' END AS protocol, CASE WHEN part % 2 = 0 THEN true END AS zs, CASE part % 3 WHEN 0 THEN true WHEN 1 THEN false END AS open FROM r JOIN p ON r.id = p.id),
  mv AS (SELECT DISTINCT bench, split, id FROM j0 WHERE audit_std = false),
  j1 AS (SELECT j0.*, mv.id IS NOT NULL AS moved, coalesce(NOT audit_std, NOT cmp, priv = 'oracle maps') AS nonstd,
    (coalesce(ok, false) OR coalesce(audit_ok, false)) AND coalesce(audit_ok, true) AND NOT coalesce(splv > srv + 0.05, false) AS usable,
    regexp_matches(method, 'small') AS abl0 FROM j0 LEFT JOIN mv USING (bench, split, id)),
  j AS (SELECT *, eval_set = 'full' AND NOT nonstd AND NOT (moved AND audit_std IS NULL) AS comparable FROM j1)"""


@query(f"WITH {JUDGED} SELECT id, part, supp, line, usable, comparable FROM j")
def board_usable(spark, d):
    j = board.comparable(judged(spark, d))
    return j.select(*_PLACE, board.usable(F.col("ok"), F.col("audit_ok"), F.col("m")).alias("usable"), "comparable")


@query(f"WITH {JUDGED} SELECT bench, split, count(*) FILTER (coalesce(zs, false))::BIGINT AS zero_shot, count(*) FILTER (open = false)::BIGINT AS closed, count(*) FILTER (coalesce(ok, false))::BIGINT AS verified, count(*) FILTER (NOT nonstd AND eval_set = 'full' AND pd IN ('1-URGENT', '5-LOW'))::BIGINT AS standard FROM j GROUP BY 1, 2")
def board_filtered(spark, d):
    j = judged(spark, d)
    tests = {"zero_shot": board.filters(zero_shot=True), "closed": board.filters(open_weights=False), "verified": board.filters(verified=True), "standard": board.filters(standard=True, eval_set="full", paradigms=["1-URGENT", "5-LOW"])}
    return j.groupBy("bench", "split").agg(*(F.count_if(x).alias(k) for k, x in tests.items()))


@query(f"WITH {ROWS} SELECT id, part, supp, line, part % 4 IN (0, 1, 2) AS loose, part % 4 IN (0, 1) AS strict FROM r")
def board_ablations(spark, d):
    k = F.col("part") % 4
    said = F.concat(F.regexp_replace("method", "only|variant", "x"), F.when(k == 0, " w/o depth").when(k == 1, " (ablation)").when(k == 2, " with no map").otherwise(" full"))
    return rows(spark, d).select(*_PLACE, board.is_ablation(said).alias("loose"), board.is_ablation(said, strict=True).alias("strict"))


@query(f"WITH {ROWS} SELECT id, part, supp, line, bench = 'Brand#1' OR size >= 25 OR part % 9 = 0 AS worthy FROM r")
def board_worthy(spark, d):
    return rows(spark, d).select(*_PLACE, board.worthy(F.col("bench") == "Brand#1", F.col("size") * 2, F.col("part") % 9 == 0).alias("worthy"))


@query(f"WITH {ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY id, method ORDER BY value DESC, {_SEQ}) AS nth FROM r) SELECT id, method, part, supp, line, value FROM k WHERE nth = 1")
def board_best_methods(spark, d):
    r = rows(spark, d).withColumn("_seq", F.col("id") * 100000000 + F.col("part") * 1000 + F.col("supp"))
    return board.best_rows(r, F.col("value"), by=("id", "method")).select("id", "method", "part", "supp", "line", "value")


# ---- surveys ------------------------------------------------------------------------------

BEST = f"""{JUDGED}, k0 AS (SELECT *, srv AS val, CASE WHEN comparable THEN 0 WHEN protocol IS NOT NULL AND NOT (coalesce(audit_std = false, false) AND NOT subset_note) THEN 1 END AS cls FROM j WHERE usable AND srv > 1),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bench, split, id ORDER BY cls, CASE WHEN regexp_matches(lower(method), 'w/o|without|\\bno\\b|ablation|\\bonly\\b|variant|†|tokens per|\\bbaseline\\b|, and|, ') THEN 1 ELSE 0 END, val DESC, seq) AS nth FROM k0 WHERE cls IS NOT NULL) WHERE nth = 1)"""


@query(f"WITH {BEST} SELECT bench, split, id, cls::INT AS cls, val AS value, part, supp FROM best")
def survey_best_rows(spark, d):
    return survey.best_of_papers(judged(spark, d), "SR").select("bench", "split", "id", "cls", "value", "part", "supp")


@query(f"""WITH {BEST}, s AS (SELECT *, row_number() OVER (PARTITION BY bench, split, pd, cls ORDER BY val DESC, seq)::INT AS rank FROM best WHERE c >= 100000), k AS (SELECT * FROM s WHERE rank <= CASE cls WHEN 0 THEN 4 ELSE 2 END)
  SELECT bench, split, pd, cls::INT AS cls, id, val AS value, rank, CASE WHEN cls = 0 AND place <= 2 THEN place END::INT AS place FROM (SELECT *, dense_rank() OVER (PARTITION BY bench, split, cls ORDER BY val DESC) AS place FROM k)""")
def survey_main_table(spark, d):
    best = survey.best_of_papers(judged(spark, d), "SR")
    out = survey.main_table(best, F.col("c") >= 100000, "SR")
    return out.select("bench", "split", "pd", "cls", "id", "value", F.col("rank").cast("int").alias("rank"), F.col("place").cast("int").alias("place"))


@query(f"""WITH {BEST}, b AS (SELECT *, CASE cls WHEN 0 THEN 'comparable' ELSE 'shared' END AS block, CASE cls WHEN 0 THEN pd ELSE protocol END AS grp FROM best WHERE c >= 50000),
  k AS (SELECT *, row_number() OVER (PARTITION BY bench, split, block, grp ORDER BY val DESC, seq)::INT AS rank FROM b) SELECT bench, split, block, grp AS "group", id, val AS value, rank FROM k WHERE block = 'shared' OR rank <= 2 OR c > 400000""")
def survey_appendix(spark, d):
    best = survey.best_of_papers(judged(spark, d), "SR")
    out = survey.appendix_table(best, F.col("c") >= 50000, F.col("c") > 400000, "SR", 2)
    return out.select("bench", "split", "block", "group", "id", "value", F.col("rank").cast("int").alias("rank"))


_FIG = f"{PAPERS}, f AS (SELECT vn AS grp, id, round(y + (month(date) - 0.5) / 12, 9) AS time, c AS value, CASE WHEN id % 4 = 0 THEN NULL ELSE 'Paper' || id END AS n FROM p), rec AS (SELECT * FROM (SELECT *, coalesce(max(value) OVER (PARTITION BY grp ORDER BY time, value DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM f) WHERE value > before)"


def _figure(spark, d) -> DataFrame:
    p = papers(spark, d)
    at = F.round(trends.fractional_year(F.col("d"), F.col("y"), half=True), 9)
    name = F.when(F.col("id") % 4 != 0, F.concat(F.lit("Paper"), F.col("id").cast("string")))
    return p.select(F.col("vn").alias("grp"), "id", at.alias("at"), F.col("c").alias("value"), name.alias("n"))


@query(f"WITH {_FIG} SELECT grp, id, time, value, before FROM rec")
def figure_records(spark, d):
    return survey.progress(_figure(spark, d), ["grp"]).select("grp", "id", F.col("at").alias("time"), "value", "before")


@query(f"""WITH RECURSIVE {_FIG}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY time, value, n, id) AS i FROM rec),
  w AS (SELECT grp, i, CAST(NULL AS DOUBLE) AS la, CAST(NULL AS DOUBLE) AS lv, false AS hit FROM o WHERE i = 1
    UNION ALL SELECT o.grp, o.i, CASE WHEN h THEN o.time ELSE la END, CASE WHEN h THEN o.value ELSE lv END, h FROM (SELECT o.*, w.la, w.lv, o.n IS NOT NULL AND (w.la IS NULL OR o.time - w.la > 0.05 OR o.value - w.lv > 20000) AS h FROM w JOIN o ON o.grp = w.grp AND o.i = w.i + 1) o)
  SELECT o.grp, o.id, o.n AS label FROM w JOIN o ON o.grp = w.grp AND o.i = w.i WHERE hit""")
def figure_labels(spark, d):
    found = survey.labelled(survey.progress(_figure(spark, d), ["grp"]), ["grp"], gap=0.05, rise=20000)
    return found.select("grp", "id", "label")


@query("""WITH s AS (SELECT DISTINCT 'k' || (o_custkey % 400) AS key FROM orders), e AS (SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 'by hand' ELSE 'made' END AS src FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 10 = 0)
  SELECT s.key, coalesce(e.src, 'missing') AS src FROM s LEFT JOIN e ON s.key = e.key""")
def cited_references(spark, d):
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    texts = t(spark, d, "orders").select(F.concat(F.lit("see \\citep[p. 1]{"), key(F.col("o_custkey") % 400), F.lit(" ,"), key(F.col("o_custkey") % 400), F.lit("} and \\emph{x}")).alias("text"))
    c = t(spark, d, "customer")
    bib = lambda src: F.concat(F.lit("@misc{"), key(F.col("c_custkey")), F.lit(f", note={{{src}}}}}"))
    made = c.where("c_custkey % 3 <> 0").select(key(F.col("c_custkey")).alias("key"), bib("made").alias("bib"))
    hand = c.where("c_custkey % 10 = 0").select(key(F.col("c_custkey")).alias("key"), bib("by hand").alias("bib"))
    got, missing = survey.references(made, hand, survey.cited_keys(texts))
    return got.select("key", F.regexp_extract("bib", r"note = \{([^}]*)\}", 1).alias("src")).union(missing.select("key", F.lit("missing")))


@query(f"WITH {ROWS} SELECT DISTINCT bench FROM r WHERE size > 40 OR split = 'R'")
def benches_shown(spark, d):
    r = rows(spark, d)
    return survey.benches_shown(r.where("size > 40"), r.where("split = 'R'"))


# ---- questions ------------------------------------------------------------------------------

_ASKED = "What leads the Large-12 board (brand 12) on split R?"


def _aliases(spark) -> DataFrame:
    return spark.createDataFrame([("Large-12", "Brand#12"), ("brand one", "Brand#1"), ("brand", "Brand#3")], "alias string, name string")


@query(f"""WITH {ROWS}, n AS (SELECT bench, count(*) AS n, regexp_replace(lower(bench), '[^a-z0-9]', '', 'g') AS norm FROM r GROUP BY 1),
  q AS (SELECT k, CASE WHEN k = 1 THEN 'Brand#11' WHEN k = 2 THEN 'Brand#12' WHEN k = 3 THEN 'Brand#2' WHEN k = 4 THEN 'Brand#1' END AS bench FROM range(1, 6) t(k)) SELECT k, n.bench, n.n::BIGINT AS n FROM q JOIN n ON n.bench = q.bench""")
def question_benches(spark, d):
    """Named whole; by a longer alias; in letters and digits alone; an alias against a longer name; not at all."""
    r, a = rows(spark, d), _aliases(spark)
    n = r.groupBy("bench").agg(F.count(F.lit(1)).alias("n"))
    asked = ["best on Brand#11 today", "what leads large 12?", "numbers for brand 2 please... BRAND2", "brand one or Brand#13?", "how do maps help?"]
    a = a.where("alias <> 'brand'")
    found = [answer.bench_of(q, r, a).select(F.lit(i).cast("long").alias("k"), "bench") for i, q in enumerate(asked, 1)]
    return reduce(DataFrame.union, found).join(n, "bench").select("k", "bench", "n")


@query(f"""WITH {JUDGED}, s AS (SELECT *, srv AS val FROM j WHERE bench = 'Brand#12' AND split = 'R' AND eval_set <> 'subset' AND usable), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, method ORDER BY val DESC, seq) AS nth FROM s) WHERE nth = 1),
  k AS (SELECT *, row_number() OVER (ORDER BY val DESC, seq) AS a, row_number() OVER (PARTITION BY pd ORDER BY val DESC, seq) AS z FROM b) SELECT id, method, part, supp, pd, 'SR' AS metric, val AS value, NOT nonstd AND NOT (moved AND audit_std IS NULL) AS comparable FROM k WHERE a <= 12 OR z <= 6""")
def question_board(spark, d):
    found = answer.board_rows(_ASKED, judged(spark, d), _aliases(spark))
    return found.select("id", "method", "part", "supp", "pd", "metric", "value", "comparable")


@query(f"""WITH {PAPERS}, f AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS rank FROM p WHERE sc = 'core') WHERE rank <= 24), l AS (SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS place FROM p) WHERE place <= 8),
  x AS (SELECT l.id, place FROM l WHERE l.id NOT IN (SELECT id FROM f)) SELECT id, row_number() OVER (ORDER BY part, k)::INT AS pos FROM (SELECT id, 0 AS part, rank AS k FROM f WHERE rank <= greatest(8, 24 - (SELECT count(*) FROM x)) UNION ALL SELECT id, 1, place FROM x)""")
def answer_papers(spark, d):
    from pyspark.sql import Window

    p = papers(spark, d)
    top = lambda df, n, name: df.orderBy(F.col("c").desc(), "id").limit(n).withColumn(name, F.row_number().over(Window.orderBy(F.col("c").desc(), "id"))).select("id", name)
    found = answer.with_leaders(top(p.where("sc = 'core'"), 24, "rank"), top(p, 12, "place"), p)
    return found.select("id", F.row_number().over(Window.orderBy("part", "at")).cast("int").alias("pos"))


_CT = "CASE WHEN id % 5 = 0 THEN ['survey'] ELSE [] END AS ct"


@query(f"""WITH {PAPERS}, x AS (SELECT *, {_CT} FROM p WHERE sc = 'core' AND y BETWEEN 1990 AND 2000), l AS (SELECT max(y) AS m FROM x)
  SELECT 'counts' AS part, y::VARCHAR || ' ' || pd AS key, count(*)::BIGINT AS n FROM x WHERE y IN (SELECT DISTINCT y FROM x ORDER BY y DESC LIMIT 4) GROUP BY 1, 2
  UNION ALL SELECT 'leaders', pd, id FROM (SELECT pd, id, row_number() OVER (PARTITION BY pd ORDER BY c DESC, id) AS k FROM x) WHERE k <= 4
  UNION ALL SELECT 'recent', '', id FROM (SELECT id FROM x, l WHERE y >= m - 1 ORDER BY c DESC, id LIMIT 8) UNION ALL SELECT 'surveys', '', id FROM (SELECT id FROM x WHERE len(ct) > 0 ORDER BY c DESC, id LIMIT 5)""")
def answer_overview(spark, d):
    p = papers(spark, d).withColumn("ct", F.when(F.col("id") % 5 == 0, F.array(F.lit("survey"))).otherwise(F.array().cast("array<string>")))
    parts = answer.overview(p, 1990, 2000, years=4)
    out = parts["counts"].select(F.lit("counts").alias("part"), F.concat_ws(" ", F.col("y").cast("string"), "pd").alias("key"), "n")
    out = out.union(parts["leaders"].select(F.lit("leaders"), "pd", "id"))
    for k in ("recent", "surveys"):
        out = out.union(parts[k].select(F.lit(k), F.lit(""), "id"))
    return out


@query(f"""WITH {LIBRARY} SELECT id, '[' || id || '] ' || coalesce(t, '') || ' (' || vn || ' ' || y || '; paradigm ' || pd || '; tasks ' || CASE WHEN len(coalesce(tk, [])) > 0 THEN array_to_string(tk, ', ') ELSE '-' END || '; citations ' || id || ')' || chr(10)
  || CASE WHEN id % 2 = 0 THEN 'idea ' || author ELSE '' END || CASE WHEN id % 3 = 0 THEN ' Insight: ' || pd ELSE '' END || CASE WHEN id % 5 = 0 THEN ' Results: ' || vn WHEN id % 2 = 1 THEN ' Abstract: ' || coalesce(t, '') ELSE '' END AS line FROM lib WHERE t IS NOT NULL""")
def context_lines(spark, d):
    lib, k = library(spark, d).where("t is not null"), F.col("id")
    notes = {"ki": F.when(k % 2 == 0, F.concat(F.lit("idea "), "author")), "ins": F.when(k % 3 == 0, F.col("pd")), "res": F.when(k % 5 == 0, F.col("vn")), "ab": F.col("t"), "c": k}
    return answer.context_lines(lib.withColumns(notes))


@query(f"WITH {JUDGED} SELECT id, part, supp, '- [' || id || '] ' || method || ' (' || y || ', ' || pd || CASE WHEN coalesce(zs, false) THEN ', zero-shot' ELSE '' END || CASE WHEN comparable THEN '' ELSE ', NOT directly comparable' END || '): Size ' || size AS line FROM j")
def result_lines(spark, d):
    j = board.comparable(judged(spark, d)).withColumn("m", F.create_map(F.lit("Size"), F.col("size").cast("string")))
    # a line names its paper alone, so the row's own key travels in the id and is cut off again
    keyed = j.withColumn("id", F.concat_ws("/", "id", "part", "supp"))
    made = answer.result_lines(keyed).select(F.split("id", "/").alias("k"), "line")
    back = F.regexp_replace("line", r"^- \[([0-9]+)/[0-9]+/[0-9]+\]", r"- [$1]")
    return made.select(F.col("k")[0].cast("long").alias("id"), F.col("k")[1].cast("long").alias("part"), F.col("k")[2].cast("long").alias("supp"), back.alias("line"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'see [' || o_orderkey || '] and  or [a1]' ELSE ' alone' END AS answer FROM orders")
def answers_checked(spark, d):
    k = F.col("o_orderkey").cast("string")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("see ["), k, F.lit("] and [zz] or [a1]"))).otherwise("[gone] alone")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), answer.without_unknown(said, F.array(k, F.lit("a1"))).alias("answer"))


@query(f"WITH {PAPERS} SELECT id FROM p WHERE c > 450000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 48 UNION SELECT id FROM p WHERE y = 1999")
def citable_ids(spark, d):
    p = papers(spark, d)
    return answer.citable(p.where("c > 450000"), t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("id")), p.where("y = 1999"))


# ---- pinned names and boosted retrieval -----------------------------------------------------------

@query(f"WITH {PAPERS} SELECT id FROM p WHERE author IN ('Customer#000000007', 'Customer#000000011') ORDER BY c DESC, id LIMIT 5")
def named_papers(spark, d):
    p = papers(spark, d).withColumn("n", F.col("author"))
    return retrieval.named(p, "compare customer#000000007, Customer#000000011 and customer#0000000 here").select("id")


_PINNED = """WITH w(term) AS (VALUES ('ther'), ('onble')), x AS (SELECT doc_id AS id, n_chars, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.\\-]*[a-z0-9+]|[a-z0-9]')) AS term FROM documents), s AS (SELECT id, n_chars, term FROM x WHERE term NOT IN (""" + ", ".join(f"'{w}'" for w in retrieval.STOP) + """)),
  l AS (SELECT id, count(*) * 2.0::DOUBLE AS dl FROM s GROUP BY 1), a AS (SELECT (SELECT count(*) FROM documents) AS n, sum(dl) / (SELECT count(*) FROM documents) AS mean FROM l), p AS (SELECT id, term, count(*) * 2.0::DOUBLE AS tf FROM s WHERE term IN (SELECT term FROM w) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  sc AS (SELECT p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM p JOIN f USING (term) JOIN l USING (id), a GROUP BY 1),
  b AS (SELECT d.doc_id AS id, coalesce(score, 0) * (1 + 0.06 * ln(1 + d.n_chars) + CASE WHEN lang = 'en' THEN 0.15 ELSE 0 END) AS score, CASE WHEN d.doc_id IN (3, 5) THEN 1 ELSE 0 END AS pinned FROM documents d LEFT JOIN sc ON sc.id = d.doc_id WHERE coalesce(score, 0) > 0 OR d.doc_id IN (3, 5))
  SELECT id, pinned::INT AS pinned, round(score, 6) AS score FROM b ORDER BY b.pinned DESC, b.score DESC, id LIMIT 24"""


@query(_PINNED)
def pinned_search(spark, d):
    found = retrieval.retrieve(_named_docs(spark, d), "how do name3 and name5 use ther or onble", {"t": 2.0})
    return found.select("id", F.col("pinned").cast("int").alias("pinned"), F.round("score", 6).alias("score"))


@query(_PINNED)
def indexed_search(spark, d):
    """The same from a written index."""
    docs, path = _named_docs(spark, d), f"{shared_folder(spark)}/paperloom/index-{uuid.uuid4().hex}"
    index.write(docs, path, {"t": 2.0}, buckets=16)
    found = index.retrieve(docs, path, "how do name3 and name5 use ther or onble")
    return found.select("id", F.col("pinned").cast("int").alias("pinned"), F.round("score", 6).alias("score"))


def _named_docs(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("name"), F.col("doc_id").cast("string")).alias("n"), F.col("text").alias("t"), F.col("n_chars").alias("c"), F.when(F.col("lang") == "en", "core").otherwise("out").alias("sc"), F.lit(2000).alias("y"))


# ---- orders and pages of the library ----------------------------------------------------------------

_ORDERS = {"new": "d DESC, id", "old": "d, id", "cited": "c DESC, id", "title": "lower(t) NULLS FIRST, id", "author": "lower(author), y DESC, id", "added": "d DESC, d DESC, id", "relevance": "(CASE WHEN contains(lower(coalesce(t, '')), 'ring') THEN 10 ELSE 0 END + CASE WHEN contains(lower(author), 'ring') THEN 5 ELSE 0 END + 1 + 0.9 * ln(1 + c)) DESC, d DESC, id"}


@query(f"WITH {LIBRARY} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, id, row_number() OVER (ORDER BY {o})::INT AS rank FROM lib WHERE sc = 'core' AND contains(h, 'ring') ORDER BY rank LIMIT 30)" for k, o in _ORDERS.items()))
def library_orders(spark, d):
    from pyspark.sql import Window

    lib, q = library(spark, d), search.parse("ring")
    parts = []
    for k in _ORDERS:
        page = search.search(lib, facets(), search.Spec(q, {"sc": ["core"]}, sort=k, limit=30))
        parts.append(page.select(F.lit(k).alias("sort"), "id", F.row_number().over(Window.orderBy(*search.order_by(k, q.terms))).cast("int").alias("rank")))
    return reduce(DataFrame.union, parts)


@query(f"WITH {LIBRARY} SELECT id, d FROM lib WHERE sc IN ('core', 'adjacent') ORDER BY d DESC, id LIMIT 60 OFFSET 120")
def library_page(spark, d):
    spec = search.Spec(selected={"sc": ["core", "adjacent"]}, offset=120)
    return search.search(library(spark, d), facets(), spec).select("id", "d")


# ---- authors ------------------------------------------------------------------------------------------


@query(f"{_AUTHORS} SELECT vn AS venue, count(*)::BIGINT AS n FROM x JOIN (SELECT id AS i, vn FROM p) v ON v.i = x.id WHERE list_contains(a, 'Supplier#000000002') GROUP BY 1 ORDER BY n DESC, venue LIMIT 6")
def author_venues(spark, d):
    return trends.author_venues(_authored(spark, d), "Supplier#000000002")


@query(f"{_AUTHORS} SELECT pd, v.y, count(*)::BIGINT AS n FROM x JOIN (SELECT id AS i, pd, y FROM p) v ON v.i = x.id WHERE list_contains(a, 'Supplier#000000002') GROUP BY 1, 2")
def author_paradigms(spark, d):
    return trends.author_paradigms(_authored(spark, d), "Supplier#000000002")


@query(f"{_AUTHORS} SELECT count(*)::BIGINT AS papers, count(*) FILTER (author = 'Customer#000000007')::BIGINT AS first_author, round(sum(c), 2) AS cites, min(y)::INT AS first, max(y)::INT AS last, arg_max(t, (c, id)) AS top_paper FROM x WHERE list_contains(a, 'Customer#000000007')")
def author_profile_first(spark, d):
    return trends.author_profile(_authored(spark, d), "Customer#000000007").withColumn("cites", F.round("cites", 2))


@query(f"WITH {PAPERS}, n AS (SELECT pd, count(*) AS n FROM p GROUP BY 1) SELECT pd, round(0.07 + 0.93 * sqrt(n / (SELECT max(n) FROM n)), 9) AS colour, (SELECT CASE WHEN m / 4 / 10 ^ floor(log10(m / 4)) <= 1 THEN 1 WHEN m / 4 / 10 ^ floor(log10(m / 4)) <= 2 THEN 2 WHEN m / 4 / 10 ^ floor(log10(m / 4)) <= 5 THEN 5 ELSE 10 END * 10 ^ floor(log10(m / 4)) FROM (SELECT max(n) AS m FROM n)) AS step FROM n")
def map_colours(spark, d):
    n = papers(spark, d).groupBy("pd").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most)).select("pd", F.round(trends.scale_colour(F.col("n"), F.col("most")), 9).alias("colour"), trends.nice_step(F.col("most")).alias("step"))



# ---- lists of fixed lengths, packs of the newest first, assignments ---------------------------------------


@query("""SELECT 'excluded' AS list, doc_id::VARCHAR AS name FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 80) UNION ALL SELECT 'jobs', event_id::VARCHAR FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 30)
  UNION ALL SELECT 'benches', name FROM (SELECT p_name || p_brand AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 80) UNION ALL SELECT 'venues', c_name FROM (SELECT c_name, c_acctbal, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40)""")
def lists_shown(spark, d):
    of = lambda kind, df, c, *order: search.shown(df, kind, *order).select(F.lit(kind).alias("list"), F.col(c).cast("string").alias("name"))
    benches = t(spark, d, "part").groupBy(F.concat("p_name", "p_brand").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    parts = [of("excluded", t(spark, d, "documents"), "doc_id", "doc_id"), of("jobs", t(spark, d, "events"), "event_id", F.col("ts").desc(), "event_id"), of("benches", benches, "name", F.col("n").desc(), "name"), of("venues", t(spark, d, "customer"), "c_name", F.col("c_acctbal").desc(), "c_custkey")]
    return reduce(DataFrame.union, parts)


@query("""WITH r AS (SELECT o_orderkey AS id, 'leaf' || o_custkey % 40 AS leaf, year(o_orderdate)::INT AS y, o_orderkey % 3 AS rank FROM orders), x AS (SELECT leaf, 'order ' || id || ' (' || y || ')' AS said, y, rank, id FROM r)
  SELECT leaf, '# ' || leaf || chr(10) || string_agg('- ' || said, chr(10) ORDER BY y DESC, rank, id) AS text FROM x GROUP BY leaf""")
def packs_newest_first(spark, d):
    """A writer's packs for an outlook: the newest papers first, then by role."""
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    assigned = o.select(k.alias("id"), F.concat(F.lit("leaf"), (F.col("o_custkey") % 40).cast("string")).alias("leaf"), F.get(F.array(*map(F.lit, log.ROLES)), (k % 3).cast("int")).alias("role"))
    p = o.select(k.alias("id"), F.lit(None).cast("string").alias("n"), F.concat(F.lit("order "), k.cast("string")).alias("t"), F.year("o_orderdate").alias("y"))
    tree = spark.range(40).select(F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("id"), F.col("id").alias("ord"))
    return log.packs(assigned, p, tree, list(log.ROLES), recent_first=True).select("leaf", "text")


@query("""WITH a AS (SELECT doc_id AS id, doc_id % 9 AS leaf, doc_id % 11 AS alt, text, doc_id % 4 AS role FROM documents WHERE doc_id % 2 = 0)
  SELECT id, 'l' || leaf AS leaf, CASE WHEN alt < 7 THEN 'l' || alt END AS alt, CASE WHEN id % 3 = 0 THEN 't1' ELSE '' END AS threads, CASE role WHEN 0 THEN 'landmark' WHEN 1 THEN 'representative' ELSE 'incremental' END AS role, substr(text, 1, 160) AS why, id % 5 = 0 AS with_reading FROM a WHERE leaf < 7 AND id % 6 <> 0
  UNION ALL SELECT doc_id, 'l0', NULL, '', 'incremental', '', doc_id % 5 = 0 FROM documents WHERE doc_id % 6 = 0""")
def assignments_appended(spark, d):
    """Answers checked against the outline and appended to the log behind those that it has; what the log has is not asked again."""
    from paperloom.sources import io

    docs, k, none = t(spark, d, "documents"), F.col("doc_id"), F.lit(None).cast("string")
    leaf = lambda c: F.concat(F.lit("l"), c.cast("string"))
    schema = "id long, leaf string, alt string, threads array<string>, role string, why string, with_reading boolean"
    path = f"{shared_folder(spark)}/paperloom/assign-{uuid.uuid4().hex}"
    empty = F.array().cast("array<string>")
    held = docs.where(k % 6 == 0).select(k.alias("id"), leaf(F.lit(0)).alias("leaf"), none.alias("alt"), empty.alias("threads"), F.lit("incremental").alias("role"), F.lit("").alias("why"), (k % 5 == 0).alias("with_reading"))
    io.append_log(held, path)
    papers_ = docs.where(k % 2 == 0).select(k.alias("id"))
    todo = log.unassigned(papers_, io.read_jsonl(spark, path, schema))
    role = F.when(k % 4 == 0, "landmark").when(k % 4 == 1, "representative").when(k % 4 == 2, "unheard of")
    answers = docs.select(k.alias("id"), leaf(k % 9).alias("leaf"), leaf(k % 11).alias("alt"), F.when(k % 3 == 0, F.array(F.lit("t1"), F.lit("t9"))).alias("threads"), role.alias("role"), F.col("text").alias("why"))
    leaves = spark.range(7).select(leaf(F.col("id")).alias("leaf"))
    threads = spark.range(3).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("thread"))
    io.append_log(log.checked_assignments(answers, todo, leaves, threads, docs.where(k % 5 == 0).select(k.alias("uid"))), path)
    return io.read_jsonl(spark, path, schema).withColumn("threads", F.array_join("threads", ","))


@query(f"""WITH {BEST},
  b AS (SELECT CASE bench WHEN 'Brand#1' THEN 0 ELSE 1 END AS board, * FROM best WHERE bench IN ('Brand#1', 'Brand#2') AND split = 'A'),
  q1 AS (SELECT *, row_number() OVER (PARTITION BY board, cls ORDER BY val DESC, id) <= CASE cls WHEN 0 THEN 2 ELSE 1 END AS record, cls = 0 AND row_number() OVER (PARTITION BY board, pd, cls = 0 ORDER BY val DESC, id) = 1 AS leads FROM b),
  k AS (SELECT id, bool_or(record) AS record, bool_or(leads) AS leader, bool_or(id % 97 = 0) AS anchor, bool_or(c >= 450000) AS much FROM q1 GROUP BY id),
  s AS (SELECT r.id, r.pd, r.cls, r.val, r.seq, r.board, k.* EXCLUDE (id) FROM q1 r JOIN k ON r.id = k.id WHERE (k.record OR leader OR anchor OR much)),
  f AS (SELECT id, arg_min(pd, board) AS grp FROM s GROUP BY id), x AS (SELECT s.*, f.grp, row_number() OVER (PARTITION BY board, grp ORDER BY cls, val DESC, seq) <= CASE board WHEN 0 THEN 4 ELSE 2 END AS top FROM s JOIN f ON f.id = s.id),
  y AS (SELECT * FROM x WHERE id IN (SELECT id FROM x GROUP BY id HAVING bool_or(top OR anchor OR leader))),
  fig AS (SELECT best.bench, best.split, best.id, round(best.y + (month(p.date) - 0.5) / 12, 6) AS tm, val AS value FROM best JOIN p ON p.id = best.id WHERE best.bench = 'Brand#1' AND best.split = 'A' AND cls = 0),
  t AS (SELECT bench, split, CASE cls WHEN 0 THEN 'comparable' ELSE 'shared' END AS block, CASE cls WHEN 0 THEN pd ELSE protocol END AS grp, id, val FROM best WHERE bench IN ('Brand#1', 'Brand#3') AND split = 'R' OR bench = 'Brand#2' AND split = 'N'),
  tr AS (SELECT *, row_number() OVER (PARTITION BY bench, split, block, grp ORDER BY val DESC, best_seq) AS rank FROM (SELECT t.*, best.seq AS best_seq FROM t JOIN best USING (bench, split, id)))
  SELECT 'main' AS part, grp AS a, board::VARCHAR AS b, id, val::DOUBLE AS value, CASE WHEN cls = 0 THEN mark END::INT AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY board, cls ORDER BY val DESC) AS mark FROM y)
  UNION ALL SELECT 'scope', '', '', id, NULL, NULL FROM p WHERE sc IN ('core', 'adjacent') AND pd = '1-URGENT'
  UNION ALL SELECT 'figure', bench, split, id, value, NULL FROM (SELECT *, coalesce(max(value) OVER (PARTITION BY bench, split ORDER BY tm, value DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM fig) WHERE value > before
  UNION ALL SELECT 'table', bench, block || ' ' || grp, id, val, rank FROM tr WHERE block = 'shared' OR rank <= 3 OR id % 50 = 0""".replace("mark END::INT", "CASE WHEN mark <= 2 THEN mark END END::INT"))
def survey_compiled(spark, d):
    """One declaration, all of a survey's data."""
    j, p = judged(spark, d), papers(spark, d).withColumn("n", F.when(F.col("id") % 97 == 0, "Milestone"))
    b = lambda bench, split: survey.Board(bench, split, "SR")
    spec = survey.Spec(
        scope={"sc": ("core", "adjacent"), "pd": ("1-URGENT",), "y": ()},
        tables=(b("Brand#1", "R"), b("Brand#3", "R"), b("Brand#2", "N")),
        main_tables=(survey.BodyTable("nav", (b("Brand#1", "A"), b("Brand#2", "A")), anchors=("Milestone",), cites=450000),),
        figures=(b("Brand#1", "A"),),
        top=3,
    )
    made = survey.compiled(spec, p, p.select(F.col("id").alias("uid")).limit(0), j, cited=p.where("id % 50 = 0"))
    row = lambda df, part, a, b, n: df.select(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), F.col("id"), (F.col("value") if "value" in df.columns else F.lit(None)).cast("double").alias("value"), n.cast("int").alias("n"))
    none, empty = F.lit(None), F.lit("")
    parts = [row(made["main"], "main", F.col("group"), F.col("board").cast("string"), F.col("mark")), row(made["scope"], "scope", empty, empty, none), row(made["figures"], "figure", F.col("bench"), F.col("split"), none)]
    parts.append(row(made["tables"], "table", F.col("bench"), F.concat_ws(" ", "block", "group"), F.col("rank")))
    return reduce(DataFrame.union, parts)


_OPEN = "(SELECT bench FROM j GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 1)"


@query(f"""WITH {JUDGED}, a AS (SELECT * FROM j WHERE bench = {_OPEN}), o AS (SELECT * FROM a WHERE split = (SELECT split FROM a GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 1) AND coalesce(ok, false) AND NOT coalesce(nonstd, false)),
  n AS (SELECT * FROM j WHERE bench = 'Brand#7' AND split = 'A' AND eval_set = 'full' AND zs AND open = false AND pd IN ('1-URGENT', '2-HIGH'))
  SELECT 'open' AS page, bench, split, 'SR' AS key, row_number() OVER (ORDER BY srv DESC, seq)::INT AS rank, id, part, supp, srv::DOUBLE AS value FROM o
  UNION ALL SELECT 'asked', bench, split, 'SPL', row_number() OVER (ORDER BY size, seq)::INT, id, part, supp, size FROM n""")
def leaderboard_pages(spark, d):
    """A page as it opens, with two filters, and one that is asked for: any board, sort and filters in one call."""
    j = judged(spark, d)
    opened = board.page(j, bench="no such board", verified=True, standard=True, sort="nothing")
    asked = board.page(j, "Brand#7", "A", "SPL", ascending=True, eval_set="full", zero_shot=True, open_weights=False, paradigms=["1-URGENT", "2-HIGH"])
    of = lambda name, p: p.rows.select(F.lit(name).alias("page"), "bench", "split", F.lit(p.key).alias("key"), F.col("rank").cast("int").alias("rank"), "id", "part", "supp", "value")
    return of("open", opened).union(of("asked", asked))


_NOW, _THEN = "date > DATE '2001-08-01' - 365 AND date <= DATE '2001-08-01'", "date > DATE '2001-08-01' - 730 AND date <= DATE '2001-08-01' - 365"


def _shift_sql(part: str, column: str, of: str) -> str:
    """Shares of each code then and now among papers that pass ``of``."""
    return f"""SELECT '{part}', code, n, round(n / a, 6) - round(m / z, 6) FROM (SELECT code, count(*) FILTER ({_NOW})::BIGINT AS n, count(*) FILTER ({_THEN}) AS m FROM (SELECT DISTINCT id, date, unnest({column}) AS code FROM s WHERE {of}) GROUP BY 1),
    (SELECT count(*) FILTER ({_NOW}) AS a, count(*) FILTER ({_THEN}) AS z FROM s WHERE {of}) WHERE n >= 5 OR n / a >= 0.02"""


@query(f"""WITH {PAPERS}, {LABELS}, s AS (SELECT p.id, y, date, CASE pd WHEN '5-LOW' THEN 'none' ELSE pd END AS pd, tk, bm, CASE WHEN p.id % 3 = 0 THEN [] ELSE co END AS co FROM p JOIN l ON p.id = l.id WHERE sc = 'core'),
  m AS (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-08-01', INTERVAL 1 MONTH))::DATE AS month), q AS (SELECT m.month, count(s.id)::BIGINT AS n FROM m LEFT JOIN s ON date_trunc('month', s.date) = m.month GROUP BY 1),
  g AS (SELECT y, pd, count(*)::BIGINT AS n FROM s WHERE pd <> 'none' AND y > 0 GROUP BY ALL), w AS (SELECT y, sum(n) AS n FROM g GROUP BY 1)
  SELECT 'tile' AS part, unnest(['core', 'last', 'before']) AS name, unnest([count(*), count(*) FILTER ({_NOW}), count(*) FILTER ({_THEN})])::BIGINT AS n, NULL::DOUBLE AS value FROM s
  UNION ALL SELECT 'rate', unnest(['growth', 'line_now', 'line_then', 'real_now', 'real_then', 'industry']), NULL, round(unnest([count(*) FILTER ({_NOW}) / count(*) FILTER ({_THEN}) - 1, count(*) FILTER ({_NOW} AND pd = '1-URGENT') / count(*) FILTER ({_NOW} AND pd <> 'none'), count(*) FILTER (y = 1997 AND pd = '1-URGENT') / count(*) FILTER (y = 1997 AND pd <> 'none'),
    count(*) FILTER ({_NOW} AND pd <> 'none' AND list_contains(tk, 'PROMO')) / count(*) FILTER ({_NOW} AND pd <> 'none'), count(*) FILTER ({_THEN} AND pd <> 'none' AND list_contains(tk, 'PROMO')) / count(*) FILTER ({_THEN} AND pd <> 'none'), count(*) FILTER ({_NOW} AND len(co) > 0) / count(*) FILTER ({_NOW})]), 6) FROM s
  UNION ALL {_shift_sql('tasks', 'tk', 'true')} UNION ALL {_shift_sql('contribs', 'co', 'true')} UNION ALL {_shift_sql('traits', 'bm', "pd <> 'none'")} UNION ALL {_shift_sql('settings', 'tk', "pd <> 'none'")}
  UNION ALL SELECT 'benches', bench, now, before FROM (SELECT bench, count(*) FILTER ({_NOW})::BIGINT AS now, count(*) FILTER ({_THEN})::DOUBLE AS before FROM (SELECT date, unnest(bm) AS bench FROM s) GROUP BY 1 HAVING count(*) FILTER ({_NOW}) > 0 ORDER BY now DESC, bench LIMIT 10)
  UNION ALL SELECT 'momentum', strftime(month, '%Y-%m'), n, round(avg(n) OVER (ORDER BY q.month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) FROM q
  UNION ALL SELECT 'shares', g.y || ' ' || g.pd, g.n, round(g.n / w.n, 6) FROM g JOIN w ON w.y = g.y WHERE g.y >= (SELECT coalesce(min(y), 0) FROM w WHERE n >= 20)""")
def summary_page(spark, d):
    """All parts of the library's first page from one table of papers."""
    from paperloom.sources.staging import cut

    p = papers(spark, d).join(labels(spark, d), "id")
    pd_, co = F.when(F.col("pd") == "5-LOW", "none").otherwise(F.col("pd")), F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("co"))
    p = cut(p.withColumns({"pd": pd_, "ct": F.col("co"), "co": co}).withColumns({"ct": F.col("co"), "tr": F.col("bm"), "st": F.col("tk")}), "papers")
    made = trends.summary(p, F.lit("2001-08-01").cast("date"), ("1999-01-01", "2001-08-01"), ["1-URGENT"], real="PROMO")
    none = F.lit(None)
    row = lambda part, df, name, n, value: df.select(F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"), F.round(value.cast("double"), 6).alias("value"))
    flat = lambda part, names, as_n: made["tiles"].select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in names))).alias("r")).select(F.lit(part).alias("part"), "r.name", (F.col("r.x") if as_n else none).cast("long").alias("n"), F.round((none if as_n else F.col("r.x")).cast("double"), 6).alias("value"))
    moved = F.round("now", 6) - F.round(F.coalesce("before", F.lit(0.0)), 6)
    parts = [flat("tile", ["core", "last", "before"], True), flat("rate", ["growth", "line_now", "line_then", "real_now", "real_then", "industry"], False)]
    parts += [row(k, made[k], F.col("code"), F.col("n"), moved) for k in ("tasks", "contribs", "traits", "settings")]
    parts += [row("benches", made["benches"], F.col("bench"), F.col("now"), F.col("before")), row("momentum", made["momentum"], F.date_format("month", "yyyy-MM"), F.col("n"), F.col("average"))]
    parts.append(row("shares", made["shares"], F.concat_ws(" ", F.col("y").cast("string"), "pd"), F.col("n"), F.col("share")))
    return reduce(DataFrame.union, parts)
