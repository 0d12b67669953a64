"""Sources and sinks: logs, documents, feeds, fallbacks, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import as_text, csv_cell, spaced_title
from paperloom.sources import versions
from paperloom.sources.staging import cut

#: Results that a listing gives out for one query (fixed value).
CAP = 9500


def _exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's own file systems, so any store is asked."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines, in its current version if it has several; blank lines are skipped, a missing file is an empty table."""
    path = versions.current(spark, path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one row each, named by its file; bad ones are skipped."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("uid", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def read_packed_docs(archives: DataFrame, schema: str) -> DataFrame:
    """``read_docs`` of documents in archives: far fewer files than documents."""
    rows = packed_documents(archives).select("name", F.from_json("text", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("x")).where("x is not null AND x.__bad is null")
    return rows.select("x.*", F.regexp_replace("name", r"\.json$", "").alias("uid")).drop("__bad")


def read_keyed(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One JSON object of keys and verdicts, as rows; an unreadable file is an empty table."""
    schema = f"key string, value {value}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom file: id and version from the URL, white space collapsed."""
    schema = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(
        F.regexp_extract("id", r"abs/(.+?)(?:v[0-9]+)?$", 1).alias("id"),
        F.coalesce(F.regexp_extract("id", r"v([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("version"),
        squeeze("title").alias("title"),
        squeeze("summary").alias("abstract"),
        F.col("author.name").alias("authors"),
        "published",
        "updated",
        F.col("category._term").alias("categories"),
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one a line, comments after # cut off."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("id")).where("id <> ''")


def windows(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """Date windows of a paged query, ``from, to``, each with at most ``cap`` results where months allow it.

    ``counts`` is (year, total). One window if all fits, else years; of these only a year
    that is itself over the cap is split by months.
    """
    whole = counts.agg(F.min("year").alias("first"), F.max("year").alias("last"), F.sum("total").alias("all"))
    day = lambda y, m, d: F.make_date(F.col(y), F.lit(m), F.lit(d))
    one = whole.where(F.col("all") <= cap).select(day("first", 1, 1).alias("from"), day("last", 12, 31).alias("to"))
    split = counts.join(whole, F.col("all") > cap)
    years = split.where(F.col("total") <= cap).select(day("year", 1, 1).alias("from"), day("year", 12, 31).alias("to"))
    months = split.where(F.col("total") > cap).select(F.explode(F.sequence(day("year", 1, 1), day("year", 12, 1), F.expr("interval 1 month"))).alias("from")).withColumn("to", F.last_day("from"))
    return one.union(years).union(months).select(F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))


def until_low_water(pages: DataFrame, published: str, since: str) -> DataFrame:
    """The pages of a newest-first listing that are read: none behind one that ends before ``since``.

    ``pages`` has ``offset`` and the publication texts of its entries as an array.
    """
    last = F.element_at(published, -1)
    stop = pages.where(F.substring(last, 1, 7) < since).agg(F.min("offset").alias("stop"))
    return pages.join(F.broadcast(stop), F.col("offset") <= F.coalesce("stop", "offset")).drop("stop")


def first_usable(*texts: tuple[str, Column], least: int = 6000) -> tuple[Column, Column]:
    """Text and name of the first source that is long enough; else the last there is."""
    long_enough = F.coalesce(*(F.when(F.length(t) >= least, F.struct(t.alias("text"), F.lit(n).alias("source"))) for n, t in texts))
    any_ = F.coalesce(*(F.when(t.isNotNull(), F.struct(t.alias("text"), F.lit(n).alias("source"))) for n, t in reversed(texts)))
    best = F.coalesce(long_enough, any_)
    return best["text"], best["source"]


# ---- fixed values: commands that include a file, names of by-products, weights of a main file's score ----
INCLUDE = r"\\(?:input|include|subfile|(?:sub)?import\{([^}]*)\})\{([^}]+)\}"
COMMANDS = ("input{", "include{", "subfile{", "import{")
BY_PRODUCT = r"(?i)response|rebuttal|reply|suppl|supplement|appendix|cover|letter|poster|slides|review"
BY_PRODUCT_WEIGHT, ABSTRACT_WEIGHT, SHORTEST_MAIN, DEEPEST = 0.15, 1.3, 2000, 8
# ------------------------------------------------------------------------------------------------------------
_FROM, _NEXT = "\u0001", "\u0002"
#: Bytes of text that one task puts together.
TASK_BYTES = 64 << 20


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts."""
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def include_pieces(files: DataFrame, *keep: str) -> DataFrame:
    """``uid, name, keep, root, bodied, inner, at, literal, places``: a file's text between its include commands, and where the next file may lie.

    Rows that are ``inner`` are of a document's body, which a ``bodied`` file has. A ``root`` has a preamble.
    """
    root, text = F.contains("text", F.lit("\\documentclass")), F.col("text")
    body = F.when(root & F.contains("text", F.lit("\\begin{document}")), F.regexp_extract("text", r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)", 1))
    # most texts have no command, and those are not taken through the expression
    has = lambda t: reduce(Column.__or__, (F.contains(t, F.lit(c)) for c in COMMANDS))
    marked = lambda t: F.when(has(t), F.split(F.regexp_replace(t, INCLUDE, f"{_NEXT}$1{_FROM}$2{_NEXT}"), _NEXT)).otherwise(F.array(t))
    here = F.regexp_extract("name", "^(.*/)[^/]*$", 1)
    folder, file = F.split_part("part", F.lit(_FROM), F.lit(1)), F.trim(F.split_part("part", F.lit(_FROM), F.lit(2)))
    tex = F.when(F.endswith(file, F.lit(".tex")), file).otherwise(F.concat(file, F.lit(".tex")))
    places = F.transform(F.array(F.concat_ws("/", folder, tex), F.concat(here, F.concat_ws("/", folder, tex)), tex), _plain_path)
    both = F.array(F.struct(F.lit(False).alias("inner"), text.alias("t")), F.struct(F.lit(True).alias("inner"), body.alias("t")))
    each = files.select("uid", "name", *keep, root.alias("root"), F.coalesce(body != "", F.lit(False)).alias("bodied"), F.explode(both).alias("x")).select("uid", "name", *keep, "root", "bodied", "x.*").where("t <> '' OR NOT inner")
    rows = each.select("uid", "name", *keep, "root", "bodied", "inner", F.posexplode(marked(F.col("t"))).alias("at", "part"))
    is_file = F.contains("part", F.lit(_FROM))
    return rows.select("uid", "name", *keep, "root", "bodied", "inner", "at", F.when(~is_file, F.col("part")).alias("literal"), F.when(is_file, places).alias("places"))


def flat_files(files: DataFrame, *keep: str) -> DataFrame:
    """``uid, name, keep, flat``: each file with a preamble and what it includes in place, ``DEEPEST`` levels deep at most.

    Includes are edges between a paper's files; each level is one join of all open edges
    with the pieces of the files that they lead to, and a piece's place in the whole is
    the list of its places on the way. The joins know pieces by name; their texts are shuffled
    once, to their paper. How many partitions that takes goes by the texts' own size, as
    repetitive ones take many times their shuffled size in memory.
    """
    pieces = cut(include_pieces(files, *keep).withColumn("size", F.coalesce(F.octet_length("literal"), F.lit(0)).cast("long")), "pieces")
    size = pieces.agg(F.sum("size")).first()[0] or 0
    dealt = lambda df, *by: df.repartition(max(1, -(-size // TASK_BYTES)), "uid", *by)
    names = dealt(pieces.where("at = 0 AND NOT inner").select("uid", "name")).groupBy("uid").agg(F.collect_set("name").alias("names"))  # one paper's files
    child = F.try_element_at(F.filter("places", lambda p: F.array_contains("names", p) & (p != F.col("name"))), F.lit(1))
    marks = pieces.select("uid", "name", "inner", "at", *keep, "root", "bodied", F.col("literal").isNotNull().alias("said"), "places")
    tree = cut(dealt(marks).join(names, "uid").withColumn("child", child).drop("places", "names"), "includes")
    below = tree.where("inner = bodied")
    below = below.select("uid", F.col("name").alias("child"), F.col("inner").alias("in_body"), F.col("at").alias("next"), F.col("said").alias("says"), F.col("child").alias("deeper"))
    below = dealt(below, "child")
    level = tree.where("root AND NOT inner").select("uid", "name", *keep, F.array("at").alias("place"), F.col("name").alias("file"), "inner", "at", "said", "child")
    found, top = [], ["uid", "name", *keep]
    for _ in range(DEEPEST + 1):
        level = cut(level, "level")
        found.append(level.where("said").select(*top, "place", "file", "inner", "at"))
        open_ = level.where("child is not null")
        if open_.isEmpty():
            break
        found += [open_.select(*top, F.concat("place", F.array(F.lit(k))).alias("place"), F.lit("").alias("file"), F.lit(None).cast("boolean").alias("inner"), F.lit(k).alias("at")) for k in (-1, 2**30)]
        level = dealt(open_.select(*top, "place", "child"), "child").join(below, ["uid", "child"]).select(*top, F.concat("place", F.array("next")).alias("place"), F.col("child").alias("file"), F.col("in_body").alias("inner"), F.col("next").alias("at"), F.col("says").alias("said"), F.col("deeper").alias("child"))
    # a piece's text and the places that it stands at, line ends with their own; both meet with their paper
    placed = reduce(DataFrame.union, found).withColumn("literal", F.when(F.col("inner").isNull(), F.lit("\n")))
    texts = pieces.where("literal is not null").select("uid", F.col("name").alias("file"), "inner", "at", "literal")
    rows = dealt(placed.unionByName(texts, allowMissingColumns=True))
    rows = rows.withColumn("literal", F.max("literal").over(Window.partitionBy("uid", "file", "inner", "at"))).where("place is not null")  # one text
    whole = rows.groupBy(*top).agg(F.sort_array(F.collect_list(F.struct("place", "literal"))).alias("parts"))
    return whole.select(*top, F.array_join(F.transform("parts", lambda p: p["literal"]), "").alias("flat"))


def main_files(files: DataFrame) -> DataFrame:
    """``uid, text`` of each paper's main file from rows ``uid, name, text, title``.

    The score is the flat length, less for names of by-products, more with an abstract
    and for each word that title and paper share.
    """
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z]{4,})"), 1))
    stem = F.regexp_replace(F.regexp_extract("name", "([^/]*)$", 1), r"\.tex$", "")
    rows = flat_files(files, "title")
    wanted = words(F.coalesce("title", F.lit("")))
    said = words(F.regexp_extract("flat", r"(?s)\\title\{(.{0,300}?)\}", 1))
    shared = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, said)) / F.size(wanted)).otherwise(0.0)
    score = F.length("flat") * F.when(stem.rlike(BY_PRODUCT), BY_PRODUCT_WEIGHT).otherwise(1.0)
    score = score * F.when(F.contains("flat", F.lit("\\begin{abstract}")) | F.contains("flat", F.lit("\\abstract")), ABSTRACT_WEIGHT).otherwise(1.0) * (1 + shared)
    best = rows.groupBy("uid").agg(F.max_by("flat", F.struct(score.alias("score"), "name")).alias("text"))
    return best.where(F.length("text") > SHORTEST_MAIN)


def text_chain(papers: DataFrame, *sources: tuple[str, DataFrame], least: int = 6000) -> DataFrame:
    """``uid, text, source``: the first of several text tables (own cache, siblings', LaTeX, PDF, abstract) that is long enough.

    Each table is (uid, text); where none is long enough the last that has any text stands.
    """
    out = papers.select("uid")
    for i, (_, table) in enumerate(sources):
        out = out.join(table.select("uid", F.col("text").alias(f"text_{i}")), "uid", "left")
    text, source = first_usable(*((name, F.col(f"text_{i}")) for i, (name, _) in enumerate(sources)), least=least)
    return out.select("uid", text.alias("text"), source.alias("source"))


def proceedings_index(pages: DataFrame, pattern: str) -> DataFrame:
    """``title, pdf`` of every entry of proceedings pages; ``pattern`` has the link and the title as groups 1 and 2."""
    part = lambda g: F.regexp_extract_all("html", F.lit(pattern), g)
    rows = pages.select(F.explode(F.arrays_zip(part(1).alias("pdf"), part(2).alias("title"))).alias("x")).select("x.title", "x.pdf")
    return rows.withColumn("key", spaced_title(F.col("title"))).where("key <> ''").groupBy("key").agg(F.max_by("title", "pdf").alias("title"), F.max("pdf").alias("pdf"))


def zipped(requests: DataFrame, ids: str, answers: str, *keep: str) -> DataFrame:
    """Requested ids and their answers by position, missing answers null, behind the columns to keep."""
    return requests.select(*keep, F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(answers).alias("answer"))).alias("x")).select(*keep, "x.*")


def in_batches(rows: DataFrame, size: int, call, schema: str) -> DataFrame:
    """An outside service asked with ``size`` rows at a time; ``call`` maps a frame to a frame."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                yield call(pdf.iloc[at : at + size])

    return rows.mapInPandas(run, schema)


class Reloading:
    """A table that is read again when its files have changed."""

    def __init__(self, spark: SparkSession, path: str, read):
        self.spark, self.path, self.read, self.seen, self.df = spark, path, read, None, None

    def get(self) -> DataFrame:
        where = versions.current(self.spark, self.path)
        files = self.spark.read.format("binaryFile").load(where).agg(F.max("modificationTime").alias("m"), F.count(F.lit(1)).alias("n")).first()
        if (where, files["m"], files["n"]) != self.seen:
            if self.df is not None:
                self.df.unpersist()
            self.seen, self.df = (where, files["m"], files["n"]), self.read(self.spark, where).cache()
        return self.df


def links(html: Column) -> Column:
    """(href, text) of every link of a page."""
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'), 1).alias("href"), F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'), 2).alias("text"))


def first_link(locations: Column, pattern: str) -> Column:
    """The first location's match of a pattern, null without one."""
    found = F.filter(F.transform(locations, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
    return F.try_element_at(found, F.lit(1))


def lazily(spark: SparkSession, tables: dict[str, str], read=None):
    """A reader of site tables by name: each is read when it is first asked for, and once."""
    read, known = read or (lambda path: spark.read.parquet(path)), {}

    def get(name: str) -> DataFrame:
        if name not in known:
            known[name] = read(tables[name])
        return known[name]

    return get


def registry_entries(papers: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers with the publisher's entry of their DOI from the cache, and the DOIs still to ask for."""
    doi = F.lower(F.trim("doi"))
    known = cache.select(F.lower(F.trim("doi")).alias("__doi"), "bibtex")
    rows = papers.join(known, doi == F.col("__doi"), "left")
    asked = papers.where(F.col("doi").isNotNull()).select(doi.alias("doi")).distinct().join(known.select(F.col("__doi").alias("doi")), "doi", "left_anti")
    return rows.drop("__doi"), asked


# ---- sinks -------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, by: list[Column], mode: str = "overwrite", compression: str | None = None) -> None:
    """Rows in order as JSON lines. A table that is replaced is a new version beside the old one, and ``read_jsonl`` finds either whole."""
    w = df.orderBy(*by).write
    w = w.option("compression", compression) if compression else w
    if mode != "overwrite":
        w.mode(mode).json(versions.current(df.sparkSession, path))
        return
    version = versions.new_version(path)
    w.json(version)
    versions.switch(df.sparkSession, path, version)


def numbered(ordered: DataFrame, place: str = "place") -> DataFrame:
    """Rows of a sorted table with their places from 0 on: places within partitions, and how many rows are in those before.

    No task sees all rows; what meets in one is a count for each partition.
    """
    # an id has its partition above the lowest 33 bits; the table is written, so counts and rows agree
    rows = cut(ordered.withColumn("__id", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__id", 33))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(place, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__before")  # a row a partition


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(versions.current(df.sparkSession, path))


#: What a list of papers exports, and under which headings (fixed value).
EXPORTED = {"id": "id", "t": "title", "n": "name", "a": "authors", "y": "year", "d": "date", "v": "venue", "pd": "paradigm", "tk": "tasks", "bm": "benchmarks", "co": "companies", "c": "citations", "doi": "doi", "key": "bibtex_key"}
MARK = "\ufeff"


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """RFC 4180 lines, every cell quoted, arrays joined by "; "."""
    return df.select(F.array_join(F.array(*_cells(df, columns)), ",").alias("line"))


def csv_file(papers: DataFrame, by: list[Column]) -> DataFrame:
    """``line`` in order: a byte order mark and the headings, then a line for each paper with the ``EXPORTED`` columns."""
    head = papers.sparkSession.createDataFrame([(MARK + ",".join(f'"{h}"' for h in EXPORTED.values()),)], "line string")
    there = papers.select(*(F.col(c) if c in papers.columns else F.lit(None).cast("string").alias(c) for c in EXPORTED), *(k.alias(f"__by{i}") for i, k in enumerate(by)))
    keys = [f"__by{i}" for i in range(len(by))]
    lines = there.select(F.array_join(F.array(*_cells(there, list(EXPORTED))), ",").alias("line"), *keys)
    numbered = head.select(F.lit(0).alias("part"), "line", *(F.lit(None).cast(dict(lines.dtypes)[k]).alias(k) for k in keys)).union(lines.select(F.lit(1), "line", *keys))
    return numbered.orderBy("part", *keys).select("line")


def _cells(df: DataFrame, columns: list[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [csv_cell(F.array_join(F.col(c).cast("array<string>"), "; ") if kinds[c].startswith("array") else F.col(c).cast("string")) for c in columns]


def snapshot(tables: dict[str, DataFrame], path: str, drop: dict[str, list[str]] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Compressed copies of tables without some fields, and their line counts, taken from what was written in one job."""
    spark = next(iter(tables.values())).sparkSession
    kept = [name for name in sorted(tables) if name not in skip]
    for name in kept:
        tables[name].drop(*(drop or {}).get(name, [])).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    names = spark.createDataFrame([(n,) for n in kept], "name string")
    lines = spark.read.text([f"{path}/{n}" for n in kept]).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("name")) if kept else names.limit(0)
    out = names.join(lines.groupBy("name").agg(F.count(F.lit(1)).alias("lines")), "name", "left").withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))
    out.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("name string, lines long").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a snapshot, those alone that its manifest names."""
    names = {r["name"] for r in spark.read.schema("name string, lines long").json(f"{path}/manifest").collect()}
    return {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items() if n in names}


def packed_documents(archives: DataFrame, suffix: str = ".json") -> DataFrame:
    """``name, text`` of the files in tar archives, compressed or not; ``archives`` has them as ``content``, one row each."""

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    found = [(m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in tar if m.isfile() and m.name.endswith(suffix)]
                yield pd.DataFrame(found, columns=["name", "text"])

    return archives.select("content").mapInPandas(run, "name string, text string")


def pack_documents(docs: DataFrame, folder: str, archives: int = 1) -> DataFrame:
    """Documents (name, text) as tar archives of stable bytes: names sorted, times zero. Returns ``path, files``."""
    dealt = docs.select("name", "text", F.pmod(F.xxhash64("name"), F.lit(archives)).alias("archive"))

    def run(pdf):
        import gzip
        import io
        import tarfile

        import pandas as pd

        out = io.BytesIO()
        with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as zipped_, tarfile.open(fileobj=zipped_, mode="w") as tar:
            for name, text in sorted(zip(pdf["name"], pdf["text"])):
                data, info = (text or "").encode(), tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"archive": pdf["archive"].iloc[:1], "content": [out.getvalue()], "files": [len(pdf)]})

    made = dealt.groupBy("archive").applyInPandas(run, "archive long, content binary, files long")
    made.write.mode("overwrite").parquet(f"{folder}/archives")
    return docs.sparkSession.read.parquet(f"{folder}/archives").select("archive", "content", "files")


def digest_text(groups: DataFrame) -> DataFrame:
    """Markdown of grouped papers: largest group first."""
    line = F.concat(F.lit("- "), "t", F.lit(" ("), F.col("d"), F.lit(")"))
    g = groups.withColumn("line", line).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", "d", "id", "line"))).alias("rows"))
    return g.select("task", "n", F.concat(F.lit("## "), "task", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text")).orderBy(F.col("n").desc(), "task")


def notes_text(df: DataFrame, column: str) -> Column:
    return as_text(F.col(column))
