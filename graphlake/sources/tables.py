"""Reading the fact tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def latest(df: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """One row per `key`: the newest by `order`, with a total order over the rest, so the choice is stable.

    Rows without a key are left out.  One aggregation with map-side combine, whatever the group size.
    """
    rest = [c for c in columns if c != key]
    lead: list[Column] = [F.col(order).alias("__order")] if order else []
    packed = F.struct(*lead, *[F.col(c) for c in rest])
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("__row"))
    return one.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null `key`; for tables whose repeated rows agree in the columns kept."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])
