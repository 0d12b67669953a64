"""Writes that survive restarts, and state that outlives them."""

import json
import os
import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from paperloom.operators import log, publish, resolve
from paperloom.sources import io, versions
from paperloom.streaming import incremental

SCHEMA = "id string, version int, title string, queries array<string>, first_seen string, _seq long"


def drop_batch(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, p, checkpoint="ck"):
    stream = incremental.folder_stream(spark, f"{p}/in", spark.createDataFrame([], SCHEMA).schema)
    incremental.upsert_stream(stream, f"{p}/out", f"{p}/{checkpoint}", ["title"], buckets=4).awaitTermination()


def state(spark, p):
    rows = incremental.read_state(spark, f"{p}/out", SCHEMA.removesuffix(", _seq long")).collect()
    return {r["id"]: (r["version"], r["title"], sorted(r["queries"])) for r in rows}


def record(i, n=1):
    return (f"r{i}", n, f"t{n}", [f"q{n}"], "2020", i * 10 + n)


def test_a_new_checkpoint_adds_to_what_is_there(spark, tmp_path):
    for i in range(3):
        drop_batch(spark, f"{tmp_path}/in", [record(i)])
    run(spark, tmp_path)
    shutil.rmtree(tmp_path / "in")
    drop_batch(spark, f"{tmp_path}/in", [record(9), record(1, 2)])
    run(spark, tmp_path, "another")
    assert state(spark, tmp_path) == {"r0": (1, "t1", ["q1"]), "r1": (2, "t2", ["q1", "q2"]), "r2": (1, "t1", ["q1"]), "r9": (1, "t1", ["q1"])}
    assert len(versions.read_pointer(spark, f"{tmp_path}/out")["batches"]) == 2


def test_a_batch_that_runs_again_is_known(spark, tmp_path):
    for i in range(3):
        drop_batch(spark, f"{tmp_path}/in", [record(i)])
    run(spark, tmp_path)
    held = versions.read_pointer(spark, f"{tmp_path}/out")
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / "ck" / "commits" / name)  # as if the query had failed behind the write
    run(spark, tmp_path)
    assert versions.read_pointer(spark, f"{tmp_path}/out") == held and set(state(spark, tmp_path)) == {"r0", "r1", "r2"}


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_crash_about_the_commit_loses_nothing(spark, tmp_path, monkeypatch, when):
    drop_batch(spark, f"{tmp_path}/in", [record(0)])
    run(spark, tmp_path)
    real, calls = versions.commit, []

    def failing(*args):
        calls.append(1)
        if when == "after":
            real(*args)
        raise OSError("lost")

    drop_batch(spark, f"{tmp_path}/in", [record(1), record(0, 2)])
    monkeypatch.setattr(versions, "commit", failing)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path)
    monkeypatch.setattr(versions, "commit", real)
    assert calls and set(state(spark, tmp_path)) == ({"r0"} if when == "before" else {"r0", "r1"})
    run(spark, tmp_path)
    assert state(spark, tmp_path) == {"r0": (2, "t2", ["q1", "q2"]), "r1": (1, "t1", ["q1"])}


def test_a_reader_finds_the_old_table_or_the_new_one(spark, tmp_path):
    path, seen, done = f"{tmp_path}/t", set(), threading.Event()
    write = lambda n: io.write_jsonl(spark.range(n).toDF("a"), path, [F.col("a")])
    write(3)

    def read():
        while not done.is_set():
            try:
                seen.add(io.read_jsonl(spark, path, "a long").count())
            except Exception as e:  # noqa: BLE001
                seen.add(str(e)[:300])

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in (5, 3, 5, 3, 5):
            write(n)
    finally:
        done.set()
        reader.join()
    assert seen <= {3, 5} and io.read_jsonl(spark, path, "a long").count() == 5
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == 1 + versions.KEPT


def test_a_site_changes_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "site")
    tables = lambda n: {"papers": spark.range(n), "stats": spark.range(n)}
    publish.write(tables(2), path, notes=spark.createDataFrame([("a", 1)], "uid string, x int"), files=2)
    switch = versions.switch
    monkeypatch.setattr(versions, "switch", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        publish.write(tables(7), path)
    assert publish.read(spark, path, "papers", "id long").count() == 2  # what was written is not current
    monkeypatch.setattr(versions, "switch", switch)
    publish.write(tables(7), path, notes=spark.createDataFrame([("a", 2)], "uid string, x int"), files=2)
    assert {publish.read(spark, path, n, "id long").count() for n in ("papers", "stats")} == {7}
    assert publish.read_note(spark, path, "a", "uid string, x int", files=2).first()["x"] == 2


def through(spark, tmp_path, of, parts, schema, out_schema):
    """What a stream gives for parts that arrive one after another, the query started anew for each."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        of(stream).writeStream.format("parquet").option("path", f"{tmp_path}/res").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out_schema).parquet(f"{tmp_path}/res").collect())


def test_a_record_a_year_late_is_known(spark, tmp_path):
    parts = [[("a", "2024-01-01"), ("b", "2024-01-02")], [("c", "2025-06-01")], [("a", "2023-01-01"), ("d", "2022-01-01"), ("b", "2025-06-02")]]
    got = through(spark, tmp_path, lambda s: incremental.new_records(s, "id"), parts, "id string, day string", "id string, day string")
    assert [r[0] for r in got] == ["a", "b", "c", "d"]


def test_an_answer_of_22_days_is_asked_again(spark, tmp_path):
    parts = [[("a", "2024-01-01"), ("b", "2024-01-01"), ("a", "2024-01-02")], [("a", "2024-01-20"), ("b", "2024-01-23")], [("a", "2024-01-23"), ("b", "2024-02-01"), ("a", "2023-12-01")]]
    ts = lambda s: s.select("id", F.col("day").cast("timestamp").alias("ts"))
    got = through(spark, tmp_path, lambda s: incremental.due_again(ts(s), "id", "ts").select("id", F.date_format("ts", "yyyy-MM-dd").alias("day")), parts, "id string, day string", "id string, day string")
    assert got == [("a", "2024-01-01"), ("a", "2024-01-23"), ("b", "2024-01-01"), ("b", "2024-01-23")]


def plain_admission(asks, hourly, daily):
    """The rule as a sequence: (site, who, seconds, n) in order."""
    let, out = {}, {}
    for site, who, at, n in sorted(asks, key=lambda x: (x[0], x[2], x[3])):
        past = [x for x in let.setdefault(site, []) if at - x[1] < 86400]
        out[n] = "daily" if len(past) >= daily else "hourly" if sum(1 for w, t in past if w == who and at - t < 3600) >= hourly else None
        let[site] = past + ([(who, at)] if out[n] is None else [])
    return out


def test_refused_questions_do_not_count(spark, tmp_path):
    r = random.Random(3)
    asks = [(r.choice("xyz"), f"u{int(r.random() ** 2 * 6)}", r.randrange(0, 4 * 86400, 50), n) for n in range(900)]
    asks += [("x", "hot", 90_000 + i, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(asks, "site string, who string, s long, n long").withColumn("ts", F.timestamp_seconds("s"))
    want = plain_admission(asks, 3, 40)
    assert {x["n"]: x["refused"] for x in log.admitted(df, "who", "ts", "n", "site", hourly=3, daily=40).collect()} == want
    assert set(want.values()) == {None, "hourly", "daily"}
    one = {x["n"]: x["refused"] for x in log.admitted(df, "who", "ts", "n", hourly=3, daily=40).collect()}
    assert one == plain_admission([("", *a[1:]) for a in asks], 3, 40)
    parts = [[a for a in asks if a[2] // 86400 == d] for d in range(4)]
    of = lambda s: incremental.admit_stream(s.withColumn("ts", F.timestamp_seconds("s")), "site", "who", "ts", "n", 3, 40)
    assert dict(through(spark, tmp_path, of, parts, "site string, who string, s long, n long", "n long, refused string")) == want
    assert log.admitted(df.limit(0), "who", "ts", "n").count() == 0


def plain_fold(harvested, other):
    title = lambda t: "".join(c for c in (t or "").lower() if c.isascii() and c.isalnum())[:120]
    ids, titles, out = {k for k, _ in harvested}, {title(t): k for k, t in harvested}, {}
    for oa, key, t in other:
        found = key if key and key in ids else titles.get(title(t))
        own = key or f"oa:{oa}"
        if not found and own in ids:
            found = own
        if not found:
            ids.add(own)
            titles[title(t)] = own
        out[oa] = found or own
    return out


@pytest.mark.parametrize("few", [4096, 0, 7])
def test_fold_is_that_of_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(resolve, "_FEW", few)
    r = random.Random(few)
    name = lambda: r.choice(["", "!", None, *(f"Title {x}" for x in range(25))])
    harvested = [(f"h{i}", name() or "x") for i in range(12)]
    other = [(f"o{i:03}", r.choice([None, "", *(f"h{x}" for x in range(14)), *(f"n{x}" for x in range(40))]), name()) for i in range(220)]
    a = spark.createDataFrame([(*h, i) for i, h in enumerate(harvested)], "arxiv_id string, title string, _seq long")
    b = spark.createDataFrame([(*o, i) for i, o in enumerate(other)], "oa_id string, arxiv_id string, title string, _seq long")
    assert {x["oa_id"]: x["uid"] for x in resolve.fold(a, b).collect()} == plain_fold(harvested, other)
    assert resolve.fold(a, b.limit(0)).count() == 0


def test_the_log_takes_one_writer(spark, tmp_path, monkeypatch):
    for n in range(6):
        versions.commit(spark, str(tmp_path), {"version": f"v-{n}"})
    names = sorted(x for x in os.listdir(tmp_path / versions.LOG) if x.endswith(".json"))
    assert len(names) == 1 + versions.KEPT and json.loads((tmp_path / versions.LOG / names[-1]).read_text()) == {"version": "v-5"}
    assert versions.current(spark, str(tmp_path)) == f"{tmp_path}/v-5" and versions.current(spark, f"{tmp_path}/none") == f"{tmp_path}/none"
    monkeypatch.setattr(versions, "_numbers", lambda *a: [3, 4])  # another writer has been here since
    with pytest.raises(Exception, match="exist"):
        versions.commit(spark, str(tmp_path), {"version": "v-late"})
    monkeypatch.undo()
    assert versions.current(spark, str(tmp_path)) == f"{tmp_path}/v-5"
