"""Splitting oversized items at natural boundaries, with overlap, by agglomerative merging."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.sources.tables import latest, table

LIMIT, OVERLAP = 150, 10

# Lines of a file whose boundaries travel together; a boundary list is joined block by block.
_BLOCK = 4096


def pieces(start: int, end: int, boundaries: list[int], limit: int = LIMIT, overlap: int = OVERLAP, strength: dict[int, float] | None = None) -> list[tuple[int, int]]:
    """The pieces of [start, end] as inclusive ranges of at most `limit`, consecutive ones sharing `overlap`.

    Atomic segments lie between the boundaries (first positions of segments, inside the range).  Adjacent
    pairs wait in a heap; the weakest boundary is merged first (equal ones from the left) if the segments and
    the overlap that the left one carries fit together.  Boundaries left over become cuts.  A segment too long
    by itself is cut at the limit, and so is one that follows a left part no longer than the overlap.
    An empty range has no piece.
    """
    if end < start:
        return []
    if limit <= overlap:
        raise ValueError("limit must exceed overlap")
    weight = strength or {}
    cuts = sorted({b for b in boundaries if start < b <= end})
    first = [start, *cuts]
    last = [*(b - 1 for b in cuts), end]
    n = len(first)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    begins = list(first)  # where the piece begins, overlap included

    def shorten(i: int) -> None:
        """Hard cuts: while the segment is too long alone, a piece of exactly `limit` comes off its front."""
        while last[i] - begins[i] + 1 > limit:
            out.append((begins[i], begins[i] + limit - 1))
            begins[i] += limit - overlap

    out: list[tuple[int, int]] = []
    heap = [(weight.get(first[i], 0.0), first[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    uniform = not weight
    if uniform:
        shorten(0)
    while heap:
        _, _, i = heapq.heappop(heap)
        j = left[i]
        size = last[i] - begins[j] + 1
        carried = 0 if uniform or left[j] < 0 else overlap
        if size + carried <= limit:
            last[j], alive[i] = last[i], False
            right[j] = right[i]
            if right[i] >= 0:
                left[right[i]] = j
        elif uniform:
            if last[j] - begins[j] + 1 <= overlap:  # too short to end here: the cut goes on into the next segment
                last[j], alive[i], right[j] = last[i], False, right[i]
                if right[i] >= 0:
                    left[right[i]] = j
                shorten(j)
            else:
                begins[i] = last[j] + 1 - overlap
                shorten(i)
    if uniform:
        i = 0
        while i >= 0:
            out.append((begins[i], last[i]))
            i = right[i]
    else:
        i, begin = 0, start
        while i >= 0:
            while right[i] >= 0 and last[i] - begin + 1 <= overlap:  # too short to end here: it goes on into the next one
                i = right[i]
            while last[i] - begin + 1 > limit:
                out.append((begin, begin + limit - 1))
                begin += limit - overlap
            out.append((begin, last[i]))
            begin = last[i] + 1 - overlap
            i = right[i]
    return sorted(out)


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            item, a, b = [], [], []
            for key, start, end, cuts in zip(batch["item"], batch["first"], batch["last"], batch["cuts"], strict=True):
                strength = {int(c["at"]): float(c["strength"]) for c in cuts}
                weighted = strength if any(strength.values()) else None
                for p, q in pieces(int(start), int(end), list(strength), limit, overlap, weighted):
                    item.append(key)
                    a.append(p)
                    b.append(q)
            yield pd.DataFrame({"item": np.array(item, dtype=np.int64), "piece_start": np.array(a, dtype=np.int64), "piece_end": np.array(b, dtype=np.int64)})

    return run


def split_oversized(items: DataFrame, boundaries: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item, piece_start, piece_end) of each item longer than `limit`.

    items: item, place, first, last (inclusive).  boundaries: place, at, and perhaps strength; those of the same place
    inside the item, after its first position, are natural.  With strengths (null counts as 0) the weakest boundaries
    give way first; where all are equal, pieces are as long as fits, from the left.  Items with a null in any of the four
    columns, or not longer than the limit, have no row.  Repeated boundaries count once, the strongest of them.
    """
    long = items.where((F.col("last") - F.col("first") + 1) > limit).select(
        F.col("item").cast("long"), "place", F.col("first").cast("long"), F.col("last").cast("long")).where(F.col("item").isNotNull())
    blocks = long.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / _BLOCK), F.floor(F.col("last") / _BLOCK))))
    strength = F.coalesce(F.col("strength").cast("double"), F.lit(0.0)) if "strength" in boundaries.columns else F.lit(0.0)
    marks = boundaries.where(F.col("at").isNotNull() & F.col("place").isNotNull()).select(
        "place", F.col("at").cast("long").alias("at"), F.floor(F.col("at") / _BLOCK).alias("block"), strength.alias("strength"))
    inside = blocks.join(marks, ["place", "block"]).where((F.col("at") > F.col("first")) & (F.col("at") <= F.col("last")))
    once = inside.groupBy("item", "at").agg(F.max("strength").alias("strength"))
    cuts = once.groupBy("item").agg(F.collect_list(F.struct("at", "strength")).alias("cuts"))
    ready = long.join(cuts, "item", "left").select("item", "first", "last", F.coalesce("cuts", F.array().cast("array<struct<at:long,strength:double>>")).alias("cuts"))
    return ready.mapInPandas(_cut(limit, overlap), "item long, piece_start long, piece_end long")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pieces of every chunk of more than 150 lines, cut where definitions begin."""
    chunks = latest(table(spark, directory, "chunks"), "chunk_id", ["file_id", "start_line", "end_line"], "indexed_at")
    items = chunks.select(F.col("chunk_id").alias("item"), F.col("file_id").alias("place"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    marks = table(spark, directory, "symbols").select(F.col("file_id").alias("place"), F.col("start_line").alias("at"))
    split = split_oversized(items, marks)
    return split.select(F.col("item").alias("chunk_id"), F.col("piece_start").cast("int").alias("piece_start"), F.col("piece_end").cast("int").alias("piece_end"))


def p2_outer(spark: SparkSession, directory: str) -> DataFrame:
    """The same chunks cut by the heap: where the outermost definitions begin before the ones nested in them."""
    chunks = latest(table(spark, directory, "chunks"), "chunk_id", ["file_id", "start_line", "end_line"], "indexed_at")
    items = chunks.select(F.col("chunk_id").alias("item"), F.col("file_id").alias("place"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    symbols = table(spark, directory, "symbols")
    # A definition without an enclosing one is the strongest boundary, a type is stronger than what stands in it.
    strength = F.when(F.col("parent").isNull() & F.col("owner").isNull(), 2.0).when(F.col("kind").isin("class", "struct", "interface", "trait", "enum", "module"), 1.5).otherwise(1.0)
    split = split_oversized(items, symbols.select(F.col("file_id").alias("place"), F.col("start_line").alias("at"), strength.alias("strength")))
    return split.select(F.col("item").alias("chunk_id"), F.col("piece_start").cast("int").alias("piece_start"), F.col("piece_end").cast("int").alias("piece_end"))


QUERIES = {"p2_found": p2_found, "p2_outer": p2_outer}
ORACLES = {
    "p2_found": """WITH RECURSIVE c AS (SELECT chunk_id, arg_max(file_id, indexed_at) file_id, arg_max(start_line, indexed_at) s, arg_max(end_line, indexed_at) e FROM chunks GROUP BY chunk_id),
big AS (SELECT * FROM c WHERE e - s + 1 > 150),
marks AS (SELECT DISTINCT file_id, start_line AS b FROM symbols),
cuts AS (SELECT chunk_id, s, e, list(b ORDER BY b) FILTER (b IS NOT NULL) bs FROM big LEFT JOIN marks ON big.file_id = marks.file_id AND b > s AND b <= e GROUP BY chunk_id, s, e),
p AS (SELECT chunk_id, e, bs, s AS a, CASE WHEN e - s + 1 <= 150 THEN e ELSE coalesce(list_max(list_filter(bs, lambda x: x > s + 10 AND x <= s + 150)) - 1, s + 149) END AS z FROM cuts
UNION ALL SELECT chunk_id, e, bs, z - 9, CASE WHEN e - (z - 9) + 1 <= 150 THEN e ELSE coalesce(list_max(list_filter(bs, lambda x: x > z - 9 + 10 AND x <= z - 9 + 150)) - 1, z - 9 + 149) END
  FROM p WHERE z < e)
SELECT chunk_id, CAST(a AS INTEGER) piece_start, CAST(z AS INTEGER) piece_end FROM p""",
}
