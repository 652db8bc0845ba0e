"""The fact tables, cleaned: one row per key, paths in one style, and what the path alone says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.sources.tables import table


def _newest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    packed = F.max(F.struct("indexed_at", *columns)).alias("r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(packed).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def files(spark: SparkSession, directory: str) -> DataFrame:
    """file_id, repo_id, path, lines, bytes, lang, is_test, role: the newest scan of each file.

    Language, test flag and role follow from the path; what the scan says of them is often missing or wrong.
    """
    one = _newest(table(spark, directory, "files"), "file_id", ["path", "lines", "bytes", "repo_id"]).where(F.col("path").isNotNull())
    named = one.withColumn("path", P.plain(F.col("path")))
    told = named.withColumn("lang", P.language(F.col("path"))).withColumn("is_test", P.is_test_path(F.col("path")))
    return told.withColumn("role", P.role(F.col("path"), F.col("is_test")))


def texts(spark: SparkSession, directory: str) -> DataFrame:
    """file_id, content: the non-null texts, each once."""
    return table(spark, directory, "file_texts").where("content IS NOT NULL AND file_id IS NOT NULL").select("file_id", "content").dropDuplicates(["file_id"])


def symbols(spark: SparkSession, directory: str) -> DataFrame:
    """symbol_id, repo_id, file_id, name, kind, start_line, end_line, owner, parent, signature."""
    return _newest(table(spark, directory, "symbols"), "symbol_id", ["file_id", "name", "kind", "start_line", "end_line", "owner", "parent", "signature", "repo_id"])


def calls(spark: SparkSession, directory: str) -> DataFrame:
    """One row per call_id."""
    return table(spark, directory, "calls").where("call_id IS NOT NULL").dropDuplicates(["call_id"])


def imports(spark: SparkSession, directory: str) -> DataFrame:
    """repo_id, file_id, spec: distinct specs without quotes and angle brackets."""
    clean = F.trim(F.regexp_replace("spec", "[\"'`<>;]", ""))
    return table(spark, directory, "imports").select("repo_id", "file_id", clean.alias("spec")).where("spec <> '' AND file_id IS NOT NULL").distinct()


def chunks(spark: SparkSession, directory: str) -> DataFrame:
    """chunk_id, repo_id, file_id, start_line, end_line, symbol_id, len, vec_q, vec_s."""
    return _newest(table(spark, directory, "chunks"), "chunk_id", ["file_id", "start_line", "end_line", "symbol_id", "len", "vec_q", "vec_s", "repo_id"])
