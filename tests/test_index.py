"""The written index against scores over all texts."""

import os
import random
import time

from pyspark.sql import functions as F

from paperloom.operators import index, retrieval


def library(spark, n=400, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("map", "nav", "rob", "see", "go") for b in ("s", "ing", "ot", "ion", "-er", "3", "")]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = [(f"p{i:04}", r.choice([None, f"Nav{i}", "ab"]), " ".join(r.choices(words, weight, k=r.randint(0, 9))), " ".join(r.choices(words, weight, k=r.randint(0, 60))), r.choice([None, *range(2010, 2026)]), r.choice([None, *range(90)]), r.choice(["core", "adjacent"]), r.choice([0, 1, None])) for i in range(n)]
    rows.append(("empty", None, None, None, 2020, 5, "core", 1))
    return spark.createDataFrame(rows, "id string, n string, t string, ab string, y int, c int, sc string, r int")


def listed(df):
    return [(r["id"], round(r["score"], 9)) for r in df.select("id", "score").collect()]


def test_the_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "LOT", 50)  # the frequent terms have several lots
    papers, folder = library(spark), str(tmp_path / "index")
    index.write(papers, folder, buckets=8, block=4)
    for question, low, high in [("maps of seeing robots", None, None), ("map", 2015, None), ("go-er naving nav3 in 2020", None, 2018), ("nothing here", None, None), ("mapion seeion goion", 2012, 2019), ("Nav7 and Nav11 maps", 2020, None), ("the of", None, None)]:
        for k in (1, 5, 24):
            want = listed(retrieval.retrieve(papers, question, k=k, low=low, high=high))
            got = listed(index.retrieve(papers, folder, question, k=k, low=low, high=high))
            assert got == want, (question, k)


def test_papers_are_inverted_together_before_the_shuffle(spark, tmp_path, monkeypatch):
    papers = library(spark, 3000, 2).withColumn("half", F.when(F.col("id") < "p15", 0).otherwise(1)).repartition(2, "half").drop("half")
    one = retrieval.postings(papers, retrieval.FIELD_WEIGHTS)
    found = index.runs(papers, retrieval.FIELD_WEIGHTS)
    total, rows = found.agg(F.sum("n"), F.count("p")).first()
    assert total == one.count() > 20 * rows and rows <= 2 * one.select("term").distinct().count()
    assert found.where("n <> size(p)").count() == 0
    want = listed(retrieval.retrieve(papers, "maps of seeing robots"))
    for tokens, lot in ((1 << 21, 1 << 18), (100, 200)):  # all at once, and in many runs and lots
        monkeypatch.setattr(index, "TOKENS", tokens)
        monkeypatch.setattr(index, "LOT", lot)
        index.write(papers, str(tmp_path / f"index{lot}"), buckets=4, block=16)
        rows, _ = index.opened(spark, str(tmp_path / f"index{lot}"), "maps")
        held = rows.agg(F.max("df"), F.sum(F.size("ids")), F.max("lot"), F.max(F.size("ids"))).first()
        assert held[0] == held[1] == one.where("term = 'maps'").count() and (held[2] > 0) == (lot == 200) and held[3] <= 16
        assert listed(index.retrieve(papers, str(tmp_path / f"index{lot}"), "maps of seeing robots")) == want


def test_a_question_reads_its_own_buckets_and_few_blocks(spark, tmp_path):
    papers, folder = library(spark, 3000, 2), str(tmp_path / "index")
    index.write(papers, folder, buckets=16, block=8)
    rows, held = index.opened(spark, folder, "maps goion see")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    read = {r["f"].split("bucket=")[1].split("/")[0] for r in rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert 1 <= len(read) <= 3 < len([x for x in os.listdir(f"{folder}/{held['version']}/postings") if x.startswith("bucket")])
    one, _ = index.opened(spark, folder, "what about maps")
    all_blocks, opened = one.count(), index.needed(one, held["papers"], 5).count()
    assert opened <= 3 and all_blocks > 100  # of several terms, what the others may add keeps more of them


def test_the_index_follows_its_file(spark, tmp_path):
    source, folder = str(tmp_path / "papers"), str(tmp_path / "index")
    library(spark, 20).write.parquet(source)
    assert index.refreshed(spark, source, folder, buckets=2) and not index.refreshed(spark, source, folder, buckets=2)
    first = listed(index.top(spark, folder, "maps"))
    time.sleep(1.1)
    library(spark, 60, 5).write.mode("overwrite").parquet(source)
    assert index.refreshed(spark, source, folder, buckets=2) and listed(index.top(spark, folder, "maps")) != first
    index.write(library(spark, 20).limit(0), folder)
    assert listed(index.top(spark, folder, "maps")) == []
