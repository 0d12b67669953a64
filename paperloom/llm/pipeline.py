"""From raw documents to packed sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept and,
but for the last, returns the columns of documents. Columns of other names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import language, mixing, near_dup, packing, pii
from paperloom.llm.common import bounded_batches, cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain.

    Null texts, texts without letters and narrow margins go, ties with them. Repeated rows
    share their fate. Without a labelled row no language is known and all documents go;
    an empty table stays empty.
    """
    bounded_batches(spark)
    return language.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id.

    Texts without words, null ones among them, all stay. Repeated rows stay once; of rows
    of one id and different texts that of the smallest text hash. An empty table stays empty.
    """
    bounded_batches(spark)
    return near_dup.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew.

    Null and empty texts stay as they are; repeated rows are rewritten alike; spans that
    overlap are replaced together. An empty table stays empty.
    """
    bounded_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, not at all in some cases.

    A null text has size 0, a null source is one of its own, the last by name. Rows of one
    id share one draw. Sources without words have rate 0. An empty table stays empty.
    """
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids.

    A null or empty text is its end id alone. Repeated rows, the mix's copies among them,
    are documents of their own that start in different windows as long as a shard has
    other documents; ties of scores go by key. An empty table gives no pieces.
    """
    bounded_batches(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Compression, hashing and packing by similarity are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
