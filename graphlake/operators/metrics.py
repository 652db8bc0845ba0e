"""Measures of retrieval quality and weighted averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_relevant, ndcg): normalised discounted cumulative gain of the first k; 0 where nothing is relevant.

    ranked: query_id, item, at (from 0).  gold: query_id, item.  Every query of either has a row.
    """
    relevant = gold.select("query_id", "item").distinct()
    gain = ranked.where(F.col("at") < k).join(relevant, ["query_id", "item"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("at") + 2.0)).alias("dcg"))
    ideal = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    queries = ranked.select("query_id").union(relevant.select("query_id")).distinct()
    full = queries.join(ideal, "query_id", "left").join(gain, "query_id", "left")
    return full.select("query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / best).otherwise(0.0).alias("ndcg"))


def accuracy(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: queries, and for each k the share of queries whose relevant items are all (acc) or in part (hit) among the first k."""
    relevant = gold.select("query_id", "item").distinct()
    places = relevant.join(ranked.groupBy("query_id", "item").agg(F.min("at").alias("at")), ["query_id", "item"], "left")
    per = places.groupBy("query_id").agg(*[F.bool_and(F.coalesce(F.col("at") < k, F.lit(False))).alias(f"acc{k}") for k in ks], *[F.bool_or(F.coalesce(F.col("at") < k, F.lit(False))).alias(f"hit{k}") for k in ks])
    return per.agg(F.count("*").alias("queries"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for k in ks for c in (f"acc{k}", f"hit{k}")])


def weighted_mean(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """The mean of value by weight in each group."""
    return df.groupBy(*group).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def first_places(ranked: DataFrame) -> DataFrame:
    """(query_id, file_id, at): files by the place of their first chunk, counted from 0."""
    first = ranked.groupBy("query_id", "file_id").agg(F.min("at").alias("first"))
    return first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "file_id")) - 1).drop("first")
