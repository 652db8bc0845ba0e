"""Bounded per-group selections, and the session's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.plans.session import shared_folder

__all__ = ["shared_folder", "smallest_per_group", "spread"]


def smallest_per_group(df: DataFrame, group: str, value: str | Column, k: int) -> DataFrame:
    """(group, ids): the k smallest distinct values of each group, in order.

    Hot groups are reduced in two steps: first within (group, input partition), where the shuffle spreads a
    hot group over all tasks, then over what is left.
    """
    wanted = df.select(group, (F.col(value) if isinstance(value, str) else value).alias("__value"), (F.spark_partition_id() % 4096).alias("__part"))
    least = F.slice(F.array_sort(F.collect_set("__value")), 1, k)
    partial = wanted.groupBy(group, "__part").agg(least.alias("__some"))
    merged = partial.select(group, F.explode("__some").alias("__value"))
    return merged.groupBy(group).agg(F.slice(F.array_sort(F.collect_set("__value")), 1, k).alias("ids"))


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores; unchanged if its input already has them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
