"""Grouped selections: trees, change detection, top rows, budgets, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions import paths as P

_TEST, _DATA = ("test", "tests", "__tests__", "spec", "specs", "e2e"), ("testdata", "fixtures", "__fixtures__", "__snapshots__")


def fixture_trees(files: DataFrame, least: int = 1000) -> DataFrame:
    """(repo_id, dir, files): test-data trees with at least `least` files, fewer than a tenth of them named like tests.

    A tree is a directory named like test data, or one below a test directory (not src, lib or source, and not
    below src/test).  Of nested ones, each file counts for its shallowest.
    """
    parts = F.split("path", "/")
    dirs = files.select("repo_id", "path", parts.alias("ps")).where(F.size("ps") > 1)
    each = dirs.select("repo_id", "path", "ps", F.explode(F.sequence(F.lit(1), F.size("ps") - 1)).alias("depth"))

    def below(k: Column) -> Column:
        here, nxt = F.element_at("ps", k), F.element_at("ps", k + 1)
        before = F.when(k > 1, F.element_at(F.col("ps"), F.greatest(k - 1, F.lit(1)))).otherwise("")
        return here.isin(*_TEST) & ~nxt.isin("src", "lib", "source") & ~(before == "src")

    inner = F.when(F.col("depth") > 1, F.exists(F.sequence(F.lit(1), F.greatest(F.col("depth") - 1, F.lit(1))), below)).otherwise(False)
    fit = each.where(F.element_at("ps", F.col("depth")).isin(*_DATA) | inner).select("repo_id", "path", "depth", F.array_join(F.slice("ps", F.lit(1), F.col("depth")), "/").alias("dir"))
    trees = fit.groupBy("repo_id", "dir").agg(F.count("*").alias("n"), F.count_if(P.has_test_name(F.col("path"))).alias("named")).where((F.col("n") >= least) & (F.col("named") * 10 < F.col("n")))
    chosen = fit.join(trees.select("repo_id", "dir"), ["repo_id", "dir"]).groupBy("repo_id", "path").agg(F.min_by("dir", "depth").alias("dir"))
    return chosen.groupBy("repo_id", "dir").agg(F.count("*").alias("files"))


def stale(scans: DataFrame) -> DataFrame:
    """Scans whose path, size or time differs from the scan of the same file before; the first one always does."""
    seen = Window.partitionBy("file_id").orderBy("indexed_at", "path", "bytes", "mtime")
    prev = F.lag(F.struct("path", "bytes", "mtime")).over(seen)
    return scans.withColumn("prev", prev).where(F.col("prev").isNull() | ~F.struct("path", "bytes", "mtime").eqNullSafe(F.col("prev"))).drop("prev")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def line_windows(texts: DataFrame, size: int = 60) -> DataFrame:
    """(file_id, start_line, end_line): the windows of `size` lines of a text that hold more than white space."""
    lines = texts.select("file_id", F.split("content", "\n").alias("ls"))
    starts = lines.withColumn("start_line", F.explode(F.sequence(F.lit(1), F.size("ls"), F.lit(size))))
    body = F.array_join(F.slice("ls", F.col("start_line"), size), "\n")
    return starts.where(body.rlike(r"[^ \t\r\n]")).select("file_id", "start_line", F.least(F.col("start_line") + size - 1, F.size("ls")).alias("end_line"))


def consecutive_distinct(df: DataFrame, group: list[str], order: list[Column], key: list[str]) -> DataFrame:
    """Rows whose key differs from that of the row before."""
    seen = Window.partitionBy(*group).orderBy(*order)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(seen))
    first = F.row_number().over(seen) == 1
    return df.withColumn("__keep", first | ~same).where("__keep").drop("__keep")


def within_budget(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The leading rows of each group, in order, whose costs together stay within the budget."""
    seen = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(seen)).where(F.col("spent") <= budget)


def percentile_by_index(df: DataFrame, value: str, q: float) -> DataFrame:
    """(n, p): the value at index floor(n*q) of the ascending order, counted from 0; one row, nulls left out.

    The rank of the wanted row is found from exact counts per value, so no task sorts all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    return total.crossJoin(F.broadcast(_cumulative(counts, value, q, total)))


def _cumulative(counts: DataFrame, value: str, q: float, total: DataFrame) -> DataFrame:
    at = total.select(F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("at"))
    bounded = counts.repartitionByRange(F.col(value)).withColumn("__part", F.spark_partition_id())
    parts = bounded.groupBy("__part").agg(F.sum("c").alias("s"))
    before = parts.select("__part", (F.sum("s").over(Window.orderBy("__part")) - F.col("s")).alias("before"))
    running = F.sum("c").over(Window.partitionBy("__part").orderBy(value)) + F.col("before")
    return bounded.join(F.broadcast(before), "__part").withColumn("upto", running).crossJoin(F.broadcast(at)).where(F.col("upto") > F.col("at")).agg(F.min(value).alias("p"))
