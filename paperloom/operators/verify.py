"""Numbers checked against texts, and the densest place of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import number_pool


def verify_numbers(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``metrics_n, matched, verified`` to rows with ``id`` and a map ``m``: is each number in the text?

    A number counts if it is there to two decimals or one, or as a hundred times a number
    there. A row is verified if all its metrics are; without metrics it is neither.
    """
    joined = rows.join(texts.select("id", number_pool(F.col("text")).alias("__pool")), "id", "left")
    values = F.filter(F.transform(F.map_values("m"), lambda v: F.round(v.try_cast("double"), 2)), lambda x: x.isNotNull())
    pool = F.coalesce("__pool", F.array().cast("array<double>"))
    joined = joined.withColumn("__v", values).withColumn("metrics_n", F.size("__v")).withColumn("matched", F.size(F.filter("__v", lambda x: F.array_contains(pool, x) | F.array_contains(pool, F.round(x, 1)))))
    return joined.withColumn("verified", F.when(F.size("m") > 0, F.size("m") == F.col("matched"))).drop("__v", "__pool")


def densest(hits: DataFrame, group: list[str], position: str, reach: int = 2500) -> DataFrame:
    """The hit with most neighbours nearer than ``reach``, the first of equals: a range frame."""
    near = Window.partitionBy(*group).orderBy(position).rangeBetween(-(reach - 1), reach - 1)
    n = hits.withColumn("near", F.count(F.lit(1)).over(near))
    return n.groupBy(*group).agg(F.max("near").alias("near"), F.min_by(position, F.struct((-F.col("near")).alias("x"), F.col(position).alias("p"))).alias(position))
