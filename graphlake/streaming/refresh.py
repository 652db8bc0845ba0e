"""Keeping facts up to date from a stream of scanned files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlake.operators.extract import file_facts


def refresh_facts(scans: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extracts facts from a stream of scans (repo_id, file_id, lang, content, indexed_at), batch by batch, once each.

    Within a batch the newest scan of a file counts.  Every batch goes to its own folder, overwritten if the batch
    is run again; `current_facts` gives the newest facts of each file.
    """

    def each(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("file_id").agg(F.max(F.struct("indexed_at", "repo_id", "lang", "content")).alias("r")).select("file_id", "r.*")
        facts = file_facts(newest.select("repo_id", "file_id", "lang"), newest.where("content IS NOT NULL").select("file_id", "content"))
        facts.join(newest.select("file_id", "indexed_at"), "file_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return scans.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(stored: DataFrame) -> DataFrame:
    """The newest facts of each file over all batches; late scans don't replace newer ones."""
    rest = [c for c in stored.columns if c not in ("file_id", "indexed_at", "batch")]
    newest = stored.groupBy("file_id").agg(F.max_by(F.struct(*rest), F.struct("indexed_at", "batch")).alias("r"))
    return newest.select("file_id", "r.*")


def changes_per_window(scans: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(repo_id, start, files): scanned files per repository and window, scans later than `late` left out of closed windows."""
    counted = scans.withWatermark("indexed_at", late).groupBy("repo_id", F.window("indexed_at", window)).agg(F.count("*").alias("files"))
    return counted.select("repo_id", F.col("window.start").alias("start"), "files")
