"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.log import DAILY, HOURLY, Admission, upsert
from paperloom.sources import versions

#: Parts of a state table; a micro-batch rewrites those that its records fall into.
BUCKETS = 64


def sliding_counts(events: DataFrame, who: str, ts: str = "ts", window: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a visitor in sliding windows, with a watermark; batch or stream alike."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late).groupBy(who, F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(who, F.col("w.start").alias("start"), "n")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where(F.col("n") > limit)


def read_state(spark: SparkSession, path: str, schema, buckets: set[int] | None = None) -> DataFrame:
    """The state table as last committed, whole or some of its buckets."""
    held = (versions.read_pointer(spark, path) or {}).get("buckets", {})
    folders = [f"{path}/{version}/bucket={b}" for b, version in sorted(held.items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def query_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps over restarts, from its checkpoint; a new checkpoint has a new one."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def upsert_stream(batches: DataFrame, path: str, checkpoint: str, fields: list[str], buckets: int = BUCKETS):
    """A stream of harvested records merged into a table of versions, each micro-batch once.

    The table lies in buckets of ids. A micro-batch reads the buckets that its records fall
    into and writes them anew, in a folder of its own; then one file is replaced that
    names the folder of every bucket and, as a log, the last micro-batch of every query. So a
    batch is in the table with its log entry or not at all: one that is run again after a
    failure finds its entry and does nothing, and a query with a new checkpoint goes on from
    whatever is there. One query writes at a time. Replaced buckets stay for one more batch, for readers.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = query_of(spark, checkpoint)
        held = versions.read_pointer(spark, path) or {"buckets": {}, "batches": {}, "replaced": []}
        if held["batches"].get(query, -1) >= number:
            return
        columns = [c for c in batch.columns if c != "_seq"]
        schema = batch.select(*columns).schema
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # a number for each bucket at most
        now, replaced = dict(held["buckets"]), []
        if touched:
            version = versions.new_version(path)
            state = upsert(read_state(spark, path, schema, touched), batch, fields).withColumn("bucket", bucket)
            state.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(version)
            replaced = [f"{now[b]}/bucket={b}" for b in map(str, touched) if b in now]
            now |= {str(b): version.removeprefix(f"{path}/") for b in touched}
        versions.commit(spark, path, {"buckets": now, "batches": held["batches"] | {query: number}, "replaced": replaced})
        batch.unpersist()
        for old in held["replaced"]:
            versions.remove(spark, f"{path}/{old}")

    path = path.rstrip("/")
    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_records(records: DataFrame, key: str) -> DataFrame:
    """First sightings of a key, however late a repetition comes.

    The keys are state without a watermark, which grows with them and outlives restarts; a
    session for many keys sets the RocksDB state store, which keeps them on disk.
    """
    return records.dropDuplicates([key])


_ASKED = "micros long"


def due_again(requests: DataFrame, key: str, ts: str, days: int = 21) -> DataFrame:
    """``key, ts`` of requests whose key was not let through in the ``days`` before, as a stream.

    The state of a key is when it was last let through. Within a micro-batch requests count in
    their order of time; one that is older than the state's time is known.
    """

    def decide(group, frames, state: GroupState):
        at = np.sort(np.concatenate([f["at"].to_numpy() for f in frames]))  # one key's requests of one micro-batch
        last, out = (state.get[0] if state.exists else None), []
        for t in at.tolist():
            if last is None or t - last > days * 86_400_000_000:
                out.append(t)
                last = t
        state.update((last,))
        yield pd.DataFrame({"key": [group[0]] * len(out), "at": out})

    rows = requests.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    kind = dict(rows.dtypes)["key"]
    found = rows.groupBy("key").applyInPandasWithState(decide, f"key {kind}, at long", _ASKED, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


def admit_stream(asks: DataFrame, site: str, who: str, ts: str, order: str, hourly: int = HOURLY, daily: int = DAILY) -> DataFrame:
    """``order, refused`` as ``log.admitted`` gives them, for a stream whose micro-batches follow one another in time.

    A site's state is what it let through in the last day, so it has ``daily`` entries at
    most; a question older than the newest one let through is taken to be asked at that time.
    """
    rows = asks.select(F.col(site).alias("site"), F.col(who).cast("string").alias("who"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("order"))
    kinds = dict(rows.dtypes)

    def decide(group, frames, state: GroupState):
        pdf = pd.concat(list(frames)).sort_values(["at", "order"], kind="stable")  # one site's questions of one micro-batch
        held = Admission(hourly, daily, *(state.get if state.exists else ([], [])))
        newest, out = (held.let[-1][0] if held.let else -(2**62)), []
        for w, t in zip(pdf["who"], pdf["at"].tolist()):
            newest = max(newest, t)
            out.append(held.refusal(w, newest))
        state.update(([t for t, _ in held.let], [w for _, w in held.let]))
        yield pd.DataFrame({"order": pdf["order"].to_numpy(), "refused": pd.Series(out, dtype=object)})

    found = rows.groupBy("site").applyInPandasWithState(decide, f"order {kinds['order']}, refused string", "at array<long>, who array<string>", "append", GroupStateTimeout.NoTimeout)
    return found.withColumnRenamed("order", order)


def folder_stream(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, ""))
