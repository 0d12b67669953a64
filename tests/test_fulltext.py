"""What a reader gets of a full text, against the rule step by step."""

import random
import re

from pyspark.sql import functions as F

from paperloom.functions import text as tx

TABLE = re.compile(r"\\begin\{(table\*?|tabular\*?|tabularx)\}.*?\\end\{\1\}", re.S)


def tables(t):
    return "\n\n".join(m[0] for m in TABLE.finditer(t))


def blank(t):
    return re.sub(r"\n\s*\n+", "\n\n", t)


def after_begin(t):
    return t.split("\\begin{document}", 1)[-1]


def plain_condense(t, latex, budget):
    if latex:
        t = re.sub(r"(?<!\\)%.*", "", t)
        for env in (r"figure\*?", "thebibliography"):
            t = re.sub(rf"(?s)\\begin\{{{env}\}}.*?\\end\{{{env}\}}", "", t)
        t = re.sub(r"\\bibliography\{[^}]*\}", "", t)
        t = blank(after_begin(re.sub(r"\\(usepackage|newcommand|renewcommand|definecolor|def)\b.*", "", t)))
    else:
        t = blank(re.sub(r"[ \t]+", " ", t))
        if (m := re.search(r"\n\s*(References|REFERENCES|Bibliography)\s*\n", t)) and m.start() > len(t) / 2:
            t = t[: m.start()]
    if len(t) <= budget:
        return t
    head, tabs = t[: int(budget * 0.4)], tables(t)[: int(budget * 0.35)] if latex else ""
    return "\n".join([head, "", "[… middle omitted …]", "", "=== TABLES ===", tabs, "", "=== LATER SECTIONS ===", t[len(t) - (budget - len(head) - len(tabs)) :]])


def plain_prepared(t, source, budget, begin):
    if source == "latex":
        t = after_begin(re.sub(r"(?<!\\)%.*", "", t))
        t = re.sub(r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}", "", t)
        t = blank(re.sub(r"\\includegraphics(\[[^\]]*\])?\{[^}]*\}", "", re.sub(r"\\bibliography(style)?\{[^}]*\}", "", t)))
    if source == "abstract" or len(t) <= budget:
        return t
    m = re.search(r"\\appendix|\n\s*(Appendix|APPENDIX|Supplementary Material)\s*\n", t)
    if m and m.start() > begin:
        found = tables(t[m.start() :])
        short = t[: m.start()] + ("\n\n=== APPENDIX TABLES ===\n" + found if found else "")
        if len(short) <= budget:
            return short
        t = t[: m.start()]
    return plain_condense(t, source == "latex", budget)


def made(r):
    bits = ["word ", "more words  here", "\n", "\n \n\n", "50\\% ", "% comment\n", "\\cite[p]{a} ", "\\begin{table}a\\begin{tabular}b\\end{tabular}\\end{table}", "\\begin{table*}x\ny\\end{table*}", "\\begin{tabularx}{w}q\\end{tabularx}", "\\begin{figure*}z\\end{figure*}", "\\includegraphics[w]{f} ", "\\bibliography{b}", "\\bibliographystyle{s}", "\\begin{thebibliography}{9}r\\end{thebibliography}", "\\newcommand{\\a}{b}\n", "\\section{été}\n", "\nReferences\n", "\n Appendix \n", "\\appendix ", "\nSupplementary Material\n"]
    body = "".join(r.choices(bits, [30, 30, 9, 4, 3, 2, 5, 2, 1, 1, 1, 1, 1, 1, 1, 1, 3, 1, 1, 1, 1], k=r.randint(0, 160)))
    return r.choice(["", "\\documentclass{a}\\usepackage{b}\n\\begin{document}"]) + body


def test_texts_are_cut_by_the_rule(spark):
    r = random.Random(8)
    rows = [(i, made(r), r.choice(["latex", "pdf", "abstract"])) for i in range(400)] + [(900, "", "latex"), (901, None, "pdf"), (902, "x" * 2000, "pdf"), (903, "\\begin{document}", "latex")]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    got = {x["id"]: x for x in df.select("id", tx.condense(F.col("t"), 500, F.col("s") == "latex").alias("c"), tx.prepared(F.col("t"), F.col("s"), 500, appendix_from=200).alias("p")).collect()}
    kinds = set()
    for i, t, s in rows:
        assert got[i]["c"] == (None if t is None else plain_condense(t, s == "latex", 500)), (i, t)
        want = None if t is None else plain_prepared(t, s, 500, 200)
        assert got[i]["p"] == want, (i, t)
        kinds |= {k for k in ("APPENDIX TABLES", "middle omitted") if want and k in want}
    assert len(kinds) == 2
    assert len(got[902]["c"]) == 500 + len("\n\n[… middle omitted …]\n\n=== TABLES ===\n\n\n=== LATER SECTIONS ===\n")


def test_texts_with_characters_beyond_16_bits_are_cut_by_the_rule(spark):
    rows = [(i, x, s) for i, (x, s) in enumerate((x, s) for s in ("latex", "pdf") for n in (90, 120, 150, 260, 390) for x in ("\U0001f600" * n + "\\appendix " + "more " * 80, "\U0001f600" * n + "\nReferences\n" + "more " * 60))]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    got = {x["id"]: x for x in df.select("id", tx.condense(F.col("t"), 300, F.col("s") == "latex").alias("c"), tx.prepared(F.col("t"), F.col("s"), 300, appendix_from=200).alias("p")).collect()}
    for i, t, s in rows:
        assert got[i]["c"] == plain_condense(t, s == "latex", 300), (i, t)
        assert got[i]["p"] == plain_prepared(t, s, 300, 200), (i, t)


def test_latex_plain_loses_citations_figures_and_commands(spark):
    text = "\\documentclass{x} \\begin{document}A \\textbf{b}~\\cite[p]{k} 5\\% % gone\n\\begin{figure*}z\\end{figure*} \\label{q}c \\bibliography{r}"
    assert spark.range(1).select(tx.latex_plain(F.lit(text)).alias("x")).first()["x"] == "A {b}~ 5\\% c {r}"
