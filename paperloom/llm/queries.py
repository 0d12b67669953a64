"""Queries of this subpackage, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import ann, chat, decontaminate, divergence, hard_negatives, html, knn, language, mixing, near_dup, packing, pii, pipeline, token_counts
from paperloom.llm.common import bounded_batches, table


def _over(name: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a whole table, with batches of bounded size on the way to Python, and no fewer tasks than cores."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        bounded_batches(spark)
        rows, cores = table(spark, d, name), spark.sparkContext.defaultParallelism
        return digest(rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dup": _over("documents", near_dup.digest),
        "op2_mixing": _over("documents", mixing.digest),
        "op3_pii": _over("documents", pii.digest),
        "op4_chat": _over("conversations", chat.digest),
        "op5_knn": _over("embeddings", knn.digest),
        "op6_html": _over("pages", html.digest),
        "op7_ann": _over("embeddings", ann.digest),
        "op8_packing": _over("documents", packing.digest),
        "op9_token_counts": _over("documents", token_counts.digest),
        "op10_language": _over("documents", language.digest),
        "op11_decontaminate": lambda spark, d: _over("documents", lambda docs: decontaminate.digest(docs, table(spark, d, "benchmark")))(spark, d),
        "op12_hard_negatives": _over("embeddings", hard_negatives.digest),
        "op13_divergence": _over("documents", divergence.digest),
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op4_chat": chat.SQL, "op5_knn": knn.SQL, "op11_decontaminate": decontaminate.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_divergence": divergence.SQL}
