"""Filling fixed-capacity windows with documents, keeping the sources in their target proportions.

Deficit round-robin: each window grants every source its share of the capacity; a source spends what it was
granted, and what it could not spend, or spent too much, is carried to the next window.  Parts of bounded size pack
on their own; what lies in windows that are not full enough, and the deficits, go on to the next level, where fewer
pieces make fewer parts of the same size.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.shards import shared_folder
from graphlake.sources.tables import one_each, table

CAPACITY = 2048
TOKENIZER = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Pieces aimed at per packing task, at every level.
TASK_PIECES = 1_250
# The filled share from which a window is closed, by level; what is left after the last level stays as it is.
CLOSE = (0.99, 0.95)
# A level that leaves more than this share of its pieces open has found no better neighbours for them: it is the last.
STUCK = 0.75
# Queues of a task: one for each of so many largest sources, and as many that the other sources share.
QUEUES = 64
# Room up to which any source may close a window, and the gap from which it is asked to.
CLOSING_ROOM, CLOSING_GAP = 512, 64

_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """`texts` with n_tokens: the tokens of the whole text by the tokenizer whose ranks are at `path`; 0 for null."""
    columns = [c for c in texts.columns if c != text]
    kept = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != text)

    # The executors get the file from the driver; it need not lie on their machines.
    texts.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(SparkFiles.get(name))
        for batch in batches:
            out = batch[columns].copy()
            out["n_tokens"] = np.array([0 if t is None else len(encoding.encode_ordinary(t)) for t in batch[text]], dtype=np.int64)
            yield out

    return texts.select(*columns, text).mapInPandas(run, f"{kept}, n_tokens long")


class _Queue:
    """The pieces of one source, by length: the longest that fits is found by bisection."""

    def __init__(self) -> None:
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def fill(self, lengths: np.ndarray, rows: np.ndarray) -> None:
        for n, row in zip(lengths.tolist(), rows.tolist(), strict=True):
            self.by_length.setdefault(n, []).append(row)
            self.tokens += n
        self.lengths = sorted(self.by_length)

    def best(self, room: int) -> int:
        """The longest length that fits, or -1."""
        at = bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else -1

    def take(self, length: int) -> int:
        rows = self.by_length[length]
        row = rows.pop()
        self.tokens -= length
        if not rows:
            del self.by_length[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)
        return row


def queue_names(sources: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The queue of each piece: its source if that is one of the QUEUES largest, else one of QUEUES shared ones."""
    names, codes = np.unique(sources.astype(str), return_inverse=True)
    if len(names) <= 2 * QUEUES:
        return names[codes].astype(object)
    tokens = np.bincount(codes, weights=lengths, minlength=len(names))
    own = np.zeros(len(names), bool)
    own[np.lexsort((names, -tokens))[:QUEUES]] = True
    shared = [n if mine else f"\x1f{zlib.crc32(n.encode()) % QUEUES}" for n, mine in zip(names.tolist(), own.tolist(), strict=True)]
    return np.array(shared, object)[codes]


def pack(lengths: np.ndarray, sources: np.ndarray, capacity: int, share: dict[str, float] | None = None, deficit: dict[str, float] | None = None) -> np.ndarray:
    """The window number of each piece.

    share: the target proportion of each source; if none is given, the proportions of what is still to be packed, so
    that no source runs out before the others.  deficit: what each is owed from before, in tokens.  Each window grants
    every source its share of the capacity; the source owed most adds its longest piece that fits, until nothing fits
    anywhere.  A source with an empty queue passes its grant on.  Near the end of a window any source may close the gap.
    """
    queues: dict[str, _Queue] = {}
    for source in pd.unique(sources):
        rows = np.flatnonzero(sources == source)
        queues[source] = _Queue()
        queues[source].fill(lengths[rows], rows)
    names = list(queues)
    owed = np.array([(deficit or {}).get(s, 0) for s in names], float)
    fixed = None if share is None else np.array([share.get(s, 0.0) for s in names], float)
    waiting = np.array([bool(queues[s].lengths) for s in names])
    window = np.full(len(lengths), -1, np.int64)
    number = 0
    while waiting.any():
        tokens = np.array([queues[s].tokens for s in names], float)
        grant = tokens if fixed is None or not fixed[waiting].sum() else np.where(waiting, fixed, 0.0)
        owed += capacity * grant / (grant.sum() or 1.0)
        room = capacity
        turn = np.where(waiting, owed, -np.inf)
        while turn.max() > -np.inf:
            at = int(turn.argmax())
            length = queues[names[at]].best(room)
            if length < 0:
                turn[at] = -np.inf
                continue
            if room <= CLOSING_ROOM and 0 < room - length < CLOSING_GAP:
                fits = [queues[s].best(room) if w else -1 for s, w in zip(names, turn > -np.inf, strict=True)]
                if max(fits) > length:
                    length = max(fits)
                    at = max((k for k, f in enumerate(fits) if f == length), key=lambda k: owed[k])
            window[queues[names[at]].take(length)] = number
            owed[at] -= length
            room -= length
            waiting[at] = bool(queues[names[at]].lengths)
            turn[at] = owed[at] if waiting[at] else -np.inf
        number += 1
    return window


_PIECES = "doc_id long, piece int, token_start long, token_end long, n_tokens long, source string, level int, part long, window long, used long"


def _pack_part(capacity: int, share: dict[str, float] | None, level: int, close: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        real = rows[rows["doc_id"].notna()].sort_values(["doc_id", "piece"]).reset_index(drop=True)
        carried = rows[rows["doc_id"].isna()].groupby("source")["used"].sum().to_dict()
        lengths = real["n_tokens"].to_numpy(np.int64)
        queue = queue_names(real["source"].to_numpy(object), lengths) if share is None else real["source"].to_numpy(object)
        window = pack(lengths, queue, capacity, share, carried)
        used = np.bincount(window, weights=lengths, minlength=1).astype(np.int64)
        real["window"], real["level"], real["part"] = window, level, int(key[0])
        real["used"] = used[window] if len(real) else np.zeros(0, np.int64)
        # What each queue is owed by the windows that close here goes on as a row without a document.
        closed = real["used"].to_numpy() >= close * capacity
        names, codes = np.unique(queue.astype(str), return_inverse=True)
        all_tokens, closed_tokens = (np.bincount(codes, weights=w, minlength=len(names)) for w in (lengths, lengths * closed))
        due = all_tokens if share is None else np.array([share.get(n, 0.0) for n in names])
        debt = due / (due.sum() or 1.0) * closed_tokens.sum() - closed_tokens
        debts = pd.DataFrame({"source": names.astype(object), "used": np.rint(debt).astype(np.int64)}).reindex(columns=real.columns)
        debts[["level", "part"]] = level, int(key[0])
        for frame in (real, debts):
            for c in ("doc_id", "piece", "token_start", "token_end", "n_tokens", "window", "used", "part", "level"):
                frame[c] = frame[c].astype("Int64")
        return pd.concat([real, debts], ignore_index=True)[[c.split()[0] for c in _PIECES.split(", ")]]

    return run


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY, share: dict[str, float] | None = None, close: tuple[float, ...] = CLOSE) -> DataFrame:
    """(doc_id, piece, token_start, token_end, n_tokens, source, window_id, window_tokens, part, at): one row per piece.

    sizes: doc_id (unique, not null), n_tokens, source (null counts as ''); other columns are not looked at.
    A document of more than `capacity` tokens is cut into pieces of `capacity` and a rest, all others stay
    whole.  No window holds more than capacity.  share: target proportions by source, a stated few; those of the table
    if not given.  Documents without tokens fit anywhere and get a window like the others.  Windows of one part are
    meant to be read in the order of `at`: together they keep the proportions.

    Every level packs parts of about TASK_PIECES pieces, however many are left, so no task grows with the corpus; a
    part's sources are about those of the table, since pieces are spread by a hash.
    """
    clean = sizes.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), F.coalesce("source", F.lit("")).alias("source"))
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0))
    cut = clean.select("doc_id", "n", "source", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = cut.select(
        "doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("token_start"),
        F.least(F.col("n"), (F.col("piece") + 1) * F.lit(capacity).cast("long")).alias("token_end"), "source",
    ).withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("part", "long"), ("window", "long"), ("used", "long"))]
    todo = pieces.select("doc_id", "piece", "token_start", "token_end", "n_tokens", "source", *empty).checkpoint()
    left = todo.count()
    done, level = None, 0
    while True:
        parts = max(1, -(-left // TASK_PIECES))
        least = close[level] if level < len(close) and parts > 1 else 0.0
        # Pieces are spread by a hash; a debt goes to the part that continues its part's open windows.
        part = F.when(F.col("doc_id").isNull(), F.pmod(F.col("part"), F.lit(parts))).otherwise(F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(parts)))
        # An explicit number, since the rows are few bytes but much work.
        tasks = min(parts, max(4 * todo.sparkSession.sparkContext.defaultParallelism, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        packed = todo.withColumn("to_part", part).repartition(tasks, "to_part").groupBy("to_part").applyInPandas(_pack_part(capacity, share, level, least), _PIECES).checkpoint()
        rows = packed.where(F.col("doc_id").isNotNull())
        is_open = F.col("used") < F.lit(least * capacity)
        before, left = left, rows.where(is_open).count() if least else 0
        final = left == 0 or left > STUCK * before
        closed = rows if final else rows.where(~is_open)
        done = closed if done is None else done.unionByName(closed)
        if final:
            break
        todo = rows.where(is_open).unionByName(packed.where(F.col("doc_id").isNull()))
        level += 1
    window_id = F.concat_ws("-", "level", "part", "window")
    return done.select(
        "doc_id", "piece", "token_start", "token_end", "n_tokens", "source", window_id.alias("window_id"), F.col("used").alias("window_tokens"),
        F.concat_ws("-", "level", "part").alias("part"), F.col("window").alias("at"))


# Windows of a part that are looked at together, the share of the windows' space that must be used, and the most that a
# source's share of such a block may differ from its share of the table.
BLOCK, LEAST_FILLED, MOST_APART = 16, 0.99, 0.10


def block_shares(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(part, block, source, share, target): sources in full blocks of consecutive windows of a part, against the table."""
    total = packed.agg(F.sum("n_tokens").alias("tokens"))
    target = packed.groupBy("source").agg(F.sum("n_tokens").alias("t")).crossJoin(F.broadcast(total)).select("source", (F.col("t") / F.col("tokens")).alias("target"))
    blocks = packed.withColumn("block", F.floor(F.col("at") / block))
    held = blocks.groupBy("part", "block").agg(F.sum("n_tokens").alias("held"), F.count_distinct("at").alias("windows")).where(F.col("windows") == block)
    each = blocks.groupBy("part", "block", "source").agg(F.sum("n_tokens").alias("n"))
    return each.join(held, ["part", "block"]).join(target, "source").select("part", "block", "source", (F.col("n") / F.col("held")).alias("share"), "target")


def packing_checks(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of what must hold: every document packed with all of its tokens, no window overfull, little space unused, sources in proportion."""
    each = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"))
    lost = sizes.join(each, "doc_id", "full").agg(F.count("*").alias("documents"), F.coalesce(F.count_if(~F.col("n_tokens").eqNullSafe(F.col("packed"))), F.lit(0)).alias("changed"))
    windows = packed.groupBy("window_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"), (F.sum("n") / (F.count("*") * capacity) >= LEAST_FILLED).alias("filled"))
    apart = block_shares(packed).agg(F.coalesce(F.max(F.abs(F.col("share") - F.col("target"))), F.lit(0.0)).alias("apart"))
    return lost.crossJoin(F.broadcast(windows)).crossJoin(F.broadcast(apart)).select("documents", "changed", "overfull", "filled", (F.col("apart") <= MOST_APART).alias("in_proportion"))


def _sizes(spark: SparkSession, directory: str) -> DataFrame:
    documents = one_each(table(spark, directory, "documents").select("doc_id", "text", "source"), "doc_id")
    return count_tokens(documents, "text")


def p6_windows(spark: SparkSession, directory: str) -> DataFrame:
    """Windows of 2,048 tokens with all documents."""
    shared_folder(spark)
    return pack_documents(_sizes(spark, directory)).drop("part", "at")


def p6_checks(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of the windows: nothing lost or overfull, 99 % filled, sources in proportion."""
    shared_folder(spark)
    sizes = _sizes(spark, directory).checkpoint()
    return packing_checks(pack_documents(sizes), sizes)


QUERIES = {"p6_windows": p6_windows, "p6_checks": p6_checks}
ORACLES = {"p6_checks": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS overfull, true AS filled, true AS in_proportion FROM documents"}
