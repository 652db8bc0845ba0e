"""Most similar vectors for every vector, by vantage-point trees with relaxed triangle-inequality pruning.

A router tree, fitted on a bounded sample, cuts the sphere into shards; shards that turn out too large are cut again
by trees of their own.  Every vector lives in one shard.  Each shard is written once, with a tree over its vectors, to
the folder that all executors share.  A task takes the vectors of a few neighbouring shards as queries and reads, one
after the other, every shard that the (relaxed) triangle inequality does not rule out, keeping for each query only its
best so far and ruling out what is farther than those.  So no vector is copied to the shards that it asks.
"""

from __future__ import annotations

import atexit
import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.shards import shared_folder
from graphlake.sources.tables import latest, table

# A tree that routes is fitted on at most this many vectors, at least ROUTER_LEAST for each of its leaves; all are indexed.
ROUTER_SAMPLE, ROUTER_LEAST = 20_000, 16
# Vectors aimed at per shard, and per leaf of a shard's tree; a shard of HOT times as many is cut again.
SHARD_ROWS, LEAF_ROWS, HOT = 12_288, 96, 2
# Lower bounds from the triangle inequality are multiplied by this before they prune; 1 gives exact search.  Every level
# of the trees loses a little, so the factor falls with their depth: see `relaxed`.
FACTOR, FACTOR_LEVELS = 8.0, 8
# A radius shrunk to the k-th best is as near as the neighbours themselves, so it is relaxed by less.
SLACK = 3.0
K, MIN_COS = 5, 0.80
_QUERY_BLOCK = 16_384
# Neighbouring shards whose vectors one task takes as queries, at most.
GROUP_SHARDS = 8
# Rows that one task fits a tree for a hot shard on, and groups that the copies of one vector are spread over.
_CUT_ROWS, _SALTS = 20_000, 32
# Keys that occur once are told from others by this many buckets of their hashes, without a shuffle of their rows.
_BUCKETS = 1 << 20


def relaxed(n: int) -> float:
    """The factor for a collection of n vectors: FACTOR up to FACTOR_LEVELS levels, then with the cube root of their number less."""
    levels = math.log2(max(2.0, n / LEAF_ROWS))
    return max(1.0, FACTOR * min(1.0, FACTOR_LEVELS / levels) ** (1 / 3))


@dataclass
class Node:
    """An inner node keeps a vantage point (a unit vector) and the median angle to it; a leaf keeps its rows."""

    rows: np.ndarray | None = None
    vantage: np.ndarray | None = None
    median: float = 0.0
    near: Node | None = None
    far: Node | None = None
    number: int = -1
    leaves: list = field(default_factory=list)
    points: list = field(default_factory=list)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = matrix.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def angle(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Angles between rows of x and unit vectors: a metric on the sphere."""
    return np.arccos(np.clip(x @ points, -1.0, 1.0))


def _axes(spread: np.ndarray, start: np.ndarray) -> np.ndarray:
    """About the three directions in which the data vary most, by a few rounds of subspace iteration."""
    axes = start
    for _ in range(5):
        axes, _ = np.linalg.qr(spread @ (spread @ axes))
    return axes @ np.linalg.eigh(axes.T @ spread @ axes)[1][:, -3:]


def _vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The candidate whose angles spread most: points of the data, and the directions in which the data vary most.

    A vantage point need not be a data point for the triangle inequality to hold.
    """
    some = x[rng.choice(len(x), min(len(x), 1024), replace=False)]
    centred = some - some.mean(0)
    candidates = np.vstack([_axes(centred.T @ centred, some[:6].T).T, some[:5]])
    spread = angle(some, candidates.T).std(0)
    return candidates[int(spread.argmax())].astype(np.float32)


def build(x: np.ndarray, leaf: int, seed: int = 7) -> Node:
    """A vantage-point tree over the rows of x, split at median angles until no leaf has more than `leaf` rows.

    Rows that cannot be told apart (all at one angle) stay in one leaf.
    """
    rng = np.random.default_rng(seed)
    root = Node(rows=np.arange(len(x)))
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) > leaf:
            mine = x[node.rows]
            point = _vantage(mine, rng)
            d = angle(mine, point)
            middle = float(np.median(d))
            inner = d <= middle
            if not inner.all():
                node.vantage, node.median, node.number = point, middle, len(root.points)
                root.points.append(point)
                node.near, node.far = Node(rows=node.rows[inner]), Node(rows=node.rows[~inner])
                node.rows = None
                todo += [node.near, node.far]
                continue
        node.number = len(root.leaves)
        root.leaves.append(node)
    return root


def visits(root: Node, q: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
    """Each leaf with the queries (indices) that it cannot be ruled out for, and the least angle to it of each.

    A side is ruled out where the least angle that the triangle inequality leaves, times factor, exceeds the
    query's radius.  The caller may lower radius in place between two leaves.
    """
    # All at once where the tree is small; else few queries reach most of its points.
    angles = angle(q, np.array(root.points).T) if 0 < len(root.points) <= 256 else None
    todo = [(root, np.arange(len(q)), np.zeros(len(q), np.float32))]
    while todo:
        node, mine, least = todo.pop()
        alive = least * factor <= radius[mine]
        if not alive.all():
            mine, least = mine[alive], least[alive]
        if len(mine) == 0:
            continue
        if node.rows is not None:
            yield node, mine, least
            continue
        beyond = (angle(q[mine], node.vantage) if angles is None else angles[mine, node.number]) - np.float32(node.median)
        # The side that a query is on comes first: its radius may have shrunk when the other one is asked.
        todo += [(node.near, mine, np.maximum(least, beyond)), (node.far, mine, np.maximum(least, -beyond))]


def homes(root: Node, x: np.ndarray) -> np.ndarray:
    """The number of the one leaf that each row belongs to."""
    home = np.zeros(len(x), np.int64)
    for node, mine, _ in visits(root, x, np.zeros(len(x), np.float32), 1.0):
        home[mine] = node.number  # at radius 0 only ties on a median reach two leaves; one is kept
    return home


def router(sample: np.ndarray, n: int, shard_rows: int) -> Node:
    """A tree without rows that cuts n vectors into shards, fitted on a sample of them."""
    shards = max(1 if n <= shard_rows else 2, min(-(-n // shard_rows), len(sample) // ROUTER_LEAST))
    root = build(sample, -(-len(sample) // shards))
    for leaf in root.leaves:
        leaf.rows = leaf.rows[:0]
    return root


def graft(root: Node, number: int, branch: Node) -> None:
    """Puts the tree `branch` in the place of a leaf; its first leaf takes that leaf's number, the others follow the last one."""
    points, todo = len(root.points), [branch]
    root.points += branch.points
    while todo:
        node = todo.pop()
        if node.rows is None:
            node.number += points
            todo += [node.near, node.far]
    for at, leaf in enumerate(branch.leaves):
        leaf.number = len(root.leaves) if at else number
        if at:
            root.leaves.append(leaf)
    place = root.leaves[number]
    root.leaves[number] = branch.leaves[0]
    if branch.rows is None:
        place.rows, place.vantage, place.median, place.near, place.far, place.number = None, branch.vantage, branch.median, branch.near, branch.far, branch.number
    else:
        root.leaves[number] = place


def _raw(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long byte strings as rows of signed bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    n = len(array)
    if n == 0:
        return np.zeros((0, 1), np.int8)
    width = len(array[0].as_py())
    offsets = np.frombuffer(array.buffers()[1], np.int32 if pa.types.is_binary(array.type) else np.int64)[array.offset :]
    return np.frombuffer(array.buffers()[2], np.int8)[offsets[0] : offsets[0] + n * width].reshape(n, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a column of byte strings."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _pack(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(1).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int8).reshape(-1, dims)
                some = rows.any(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), _bytes(rows[some])], ["vec_id", "vec"])

    return run


_PLACED = "shard long, vec_id long, ids array<long>, vec binary"


def _place(root: Node):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = pa.array(homes(root, unit(_raw(batch.column("vec")))))
                yield pa.RecordBatch.from_arrays([home, *(batch.column(c) for c in ("vec_id", "ids", "vec"))], ["shard", "vec_id", "ids", "vec"])

    return run


def _subtree(shard_rows: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack([np.frombuffer(v, np.int8) for v in rows.sort_values("vec_id")["vec"]]))
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(router(x, int(rows["n"].iloc[0]), shard_rows))]})

    return run


def cut_hot(distinct: DataFrame, root: Node) -> DataFrame:
    """`distinct` (vec_id, ids, vec) with the shard that each vector lives in.

    Every shard of more than HOT x SHARD_ROWS vectors is cut by a tree fitted on a sample of its own, which is grafted
    onto `root`.  Goes on until no shard is too large, or those that are left can't be cut further.
    """
    before = None
    while True:
        placed = distinct.mapInArrow(_place(root), _PLACED)
        hot = [tuple(r) for r in placed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > HOT * SHARD_ROWS).orderBy("shard").collect()]
        if not hot or hot == before:
            return placed.withColumn("home", F.lit(True))
        before = hot
        sizes = F.broadcast(distinct.sparkSession.createDataFrame(hot, "shard long, n long"))
        sample = placed.join(sizes, "shard").where(F.pmod(F.xxhash64("vec"), F.lit(1_000_003)) <= F.least(F.lit(1.0), F.lit(min(_CUT_ROWS, ROUTER_SAMPLE / 2)) / F.col("n")) * 1_000_003)
        trees = sample.select("shard", "vec_id", "vec", "n").groupBy("shard").applyInPandas(_subtree(SHARD_ROWS), "shard long, tree binary")
        for r in sorted(trees.collect()):
            graft(root, r["shard"], pickle.loads(r["tree"]))  # noqa: S301


class Nearest:
    """The up to k best answers of each of n queries so far, and the radius in which better ones can be."""

    def __init__(self, n: int, k: int, cos: float, least: float, slack: float):
        self.k, self.slack = k, slack
        self.label, self.cos = np.full((n, k), -1, np.int64), np.full((n, k), least)
        self.radius = np.full(n, float(np.arccos(min(1.0, max(-1.0, cos)))) + 1e-4, np.float32)

    def add(self, query: np.ndarray, label: np.ndarray, cosine: np.ndarray) -> None:
        who, k = np.unique(query), self.k
        a = np.concatenate([np.repeat(who, k), query])
        b = np.concatenate([self.label[who].ravel(), label])
        c = np.concatenate([self.cos[who].ravel(), cosine])
        order = np.lexsort((b, -c, b < 0, a))
        a, b, c = a[order], b[order], c[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        self.label[who], self.cos[who] = b[keep].reshape(-1, k), c[keep].reshape(-1, k)
        full = who[self.label[who, -1] >= 0]
        self.radius[full] = np.minimum(self.radius[full], self.slack * np.arccos(np.clip(self.cos[full, -1], -1.0, 1.0)) + np.float32(1e-3))


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix in which little is true, faster."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def ask(root: Node, q: np.ndarray, who: np.ndarray, nearest: Nearest, factor: float, similar: Callable) -> None:
    """Adds what the rows of a tree have to the answers of the queries `who`.

    similar(queries, rows, least) gives (place among the queries, label, cosine) of the pairs whose cosine is at least
    the query's `least`.
    """
    radius = nearest.radius[who]
    for node, mine, _ in visits(root, q[who], radius, factor):
        for at in range(0, len(node.rows), 2048):
            for low in range(0, len(mine), 4096):
                part = mine[low : low + 4096]
                asked = who[part]
                i, label, cosine = similar(asked, node.rows[at : at + 2048], nearest.cos[asked, -1])
                if len(i):
                    nearest.add(asked[i], label, cosine)
                    radius[part] = nearest.radius[asked]


def search(x: np.ndarray, q: np.ndarray, k: int, cos: float, factor: float, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of up to k most similar rows of x, with a cosine of at least cos, for each row of q.

    A query's radius shrinks to its k-th best, so what is held at once is k rows a query and one leaf's hits.
    """
    root = build(x, leaf)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(q), _QUERY_BLOCK):
        part = q[begin : begin + _QUERY_BLOCK]
        nearest = Nearest(len(part), k, cos, cos - 1e-5, 1.0 if factor == 1.0 else SLACK)

        def similar(asked: np.ndarray, rows: np.ndarray, least: np.ndarray, part: np.ndarray = part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            products = part[asked] @ x[rows].T
            i, j = _places(products >= least[:, None].astype(np.float32))
            return i, rows[j], products[i, j]

        ask(root, part, np.arange(len(part)), nearest, factor, similar)
        a, place = np.nonzero(nearest.label >= 0)
        out.append((a + begin, nearest.label[a, place], nearest.cos[a, place]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names, and its path there."""
    url = urlparse(folder)
    return (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def _write(system: fs.FileSystem, path: str, content: tuple) -> None:
    # Under another name first: a task that is tried again leaves a whole file.
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(pickle.dumps(content, 5))
    system.move(draft, path)


def _read(system: fs.FileSystem, path: str) -> tuple:
    with system.open_input_file(path) as f:
        return pickle.loads(f.read())  # noqa: S301


def _store(folder: str):
    """Writes a shard: its tree, the ids and the bytes of its vectors in the order of the leaves; and the ids of equal vectors."""

    def run(rows: pa.Table) -> pa.Table:
        system, path = _system(folder)
        shard = rows.column("shard")[0].as_py()
        raw, ids = _raw(rows.column("vec")), rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        raw, ids = raw[order], ids[order]
        tree = build(unit(raw), LEAF_ROWS)
        order, at = np.concatenate([leaf.rows for leaf in tree.leaves]), 0
        for leaf in tree.leaves:
            leaf.rows, at = np.arange(at, at + len(leaf.rows), dtype=np.int32), at + len(leaf.rows)
        several = rows.filter(rows.column("ids").is_valid()).sort_by("vec_id").select(["vec_id", "ids"])
        lists = several.column("ids").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _write(system, f"{path}/{shard}.ids", (several.column("vec_id").to_numpy(), sizes, lists.flatten().to_numpy(zero_copy_only=False)))
        _write(system, f"{path}/{shard}.vectors", (tree, ids[order], raw[order]))
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(ids)], pa.int64())})

    return run


def _norms(raw: np.ndarray) -> np.ndarray:
    """Squared lengths of rows of bytes."""
    parts = [np.einsum("ij,ij->i", part, part) for at in range(0, len(raw), 65_536) for part in [raw[at : at + 65_536].astype(np.int32)]]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _expand(ids: np.ndarray, nearest: Nearest, k: int, copies: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    """The answers of the queries `ids` with equal vectors put in.

    A class of equal vectors stands for its smallest ids.  Queries that have no equals get their k best; the others,
    marked `several`, one more, since each of the class leaves itself out.
    """
    known, sizes, flat = copies
    begin = np.concatenate([[0], np.cumsum(sizes)])

    def listed(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each label how many ids it stands for, and those ids."""
        if len(known) == 0:
            return np.ones(len(labels), np.int64), labels
        at = np.minimum(np.searchsorted(known, labels), len(known) - 1)
        has = known[at] == labels
        times = np.where(has, sizes[at], 1)
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return times, np.where(np.repeat(has, times), flat[np.minimum(np.repeat(begin[at], times) + inside, len(flat) - 1)], np.repeat(labels, times))

    a, place = np.nonzero(nearest.label >= 0)
    times, others = listed(nearest.label[a, place])
    a, cosine = np.repeat(a, times), np.repeat(nearest.cos[a, place], times)
    several = np.isin(ids, known)
    mine = np.flatnonzero(several)
    times, own = listed(ids[mine])
    a, others, cosine = np.concatenate([a, np.repeat(mine, times)]), np.concatenate([others, own]), np.concatenate([cosine, np.ones(len(own))])
    order = np.lexsort((others, -cosine, a))
    a, others, cosine = a[order], others[order], cosine[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k + several[a]
    a = a[keep]
    return pa.table({"vec_id": ids[a], "other_id": others[keep], "cosine": cosine[keep], "several": several[a]})


def _answer(root: Node, folder: str, present: np.ndarray, group: int, k: int, cos: float, factor: float):
    """The answers of all vectors of the shards `present[group * g : group * (g + 1)]`, for each g of the rows."""

    def one(g: int) -> pa.Table:
        system, path = _system(folder)
        own = [int(s) for s in present[group * g : group * (g + 1)]]
        parts = [_read(system, f"{path}/{s}.vectors")[1:] for s in own]
        ids, raw = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        exact = np.float32 if raw.shape[1] < 1024 else np.float64  # whole-number products are exact in it, so equal cosines are equal
        norm, q = _norms(raw), unit(raw)
        length = np.sqrt(norm).astype(exact)
        # A few more than wanted: a radius should not shrink too soon.
        nearest = Nearest(len(ids), k + 3, cos, cos, 1.0 if factor == 1.0 else SLACK)
        reached: dict[int, list] = {}
        for node, mine, least in visits(root, q, nearest.radius, factor):
            reached[node.number] = [mine, least]
        hit: list[int] = []
        there = set(present.tolist())
        for shard in [*own, *sorted(reached.keys() - set(own))]:
            if shard not in reached or shard not in there:
                continue
            who, least = reached.pop(shard)
            who = who[least * factor <= nearest.radius[who]]
            if len(who) == 0:
                continue
            tree, labels, x = _read(system, f"{path}/{shard}.vectors")
            norm_x = _norms(x)
            length_x = np.sqrt(norm_x).astype(exact)
            found = 0

            def similar(asked: np.ndarray, rows: np.ndarray, least: np.ndarray, x=x, labels=labels, norm_x=norm_x, length_x=length_x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
                nonlocal found
                products = raw[asked].astype(exact) @ x[rows].astype(exact).T
                i, j = _places(products >= ((least - 1e-6).astype(exact) * length[asked])[:, None] * length_x[rows])
                cosine = products[i, j].astype(float) / np.sqrt(norm[asked[i]].astype(float) * norm_x[rows[j]])
                keep = (cosine >= cos) & (labels[rows[j]] != ids[asked[i]])
                i, j, cosine = i[keep], j[keep], np.round(cosine[keep], 12)
                found += len(i)
                return i, labels[rows[j]], cosine

            ask(tree, q, who, nearest, factor, similar)
            if found:
                hit.append(shard)
        wanted = np.unique(np.concatenate([nearest.label.ravel(), ids]))
        copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for shard in {*own, *hit}:
            known, sizes, flat = _read(system, f"{path}/{shard}.ids")
            some = np.isin(known, wanted)
            copies.append((known[some], sizes[some], flat[np.repeat(some, sizes)]))
        known, sizes, flat = (np.concatenate(c) for c in zip(*copies, strict=True))
        order = np.argsort(known)
        begin = np.cumsum(sizes) - sizes
        flat = flat[np.repeat(begin[order], sizes[order]) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])] if len(flat) else flat
        return _expand(ids, nearest, k, (known[order], sizes[order], flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                yield from one(g).to_batches(max_chunksize=20_000)

    return run


def _remove(folder: str) -> None:
    system, path = _system(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def repeated_buckets(df: DataFrame, key: str) -> DataFrame:
    """(bucket): those of the _BUCKETS buckets that hold a key which occurs several times; only keys are shuffled."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(_bucket(key)).distinct()


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int").alias("bucket")


def similar_vectors(vectors: DataFrame, k: int = K, min_cos: float = MIN_COS, factor: float | None = None, dims: int = 128) -> DataFrame:
    """(vec_id, other_id, cosine): up to `k` most similar other vectors of each, with a cosine of min_cos or more.

    vectors: vec_id (unique), vec (array<tinyint>).  Null, zero and wrongly long vectors count as none.  Equal
    vectors are searched once and share what is found; among equal cosines the smaller vec_id comes first.
    With factor 1 the search is exact; above, a small share of neighbours is missed; `relaxed` chooses it if none is given.
    """
    spark = vectors.sparkSession
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vectors-{uuid.uuid4().hex}"
    atexit.register(_remove, folder)  # the result is read from it until then
    given = vectors.where(F.col("vec_id").isNotNull() & (F.size("vec") == dims)).select(F.col("vec_id").cast("long").alias("vec_id"), "vec")
    given.mapInArrow(_pack(dims), "vec_id long, vec binary").write.parquet(f"{folder}/valid")
    valid = spark.read.parquet(f"{folder}/valid").select("vec_id", "vec", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("h2"))
    n = valid.count()
    if n == 0:
        return valid.select("vec_id", F.lit(0).cast("long").alias("other_id"), F.lit(0.0).alias("cosine")).limit(0)
    factor = relaxed(n) if factor is None else factor
    share = min(1.0, ROUTER_SAMPLE / n)
    sample = valid.where(F.pmod("h", F.lit(1_000_003)) <= share * 1_000_003).select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(ROUTER_SAMPLE).collect()
    x = unit(np.stack([np.frombuffer(r["vec"], np.int8) for r in sample])) if sample else unit(np.ones((1, dims)))
    root = router(x, n, SHARD_ROWS)
    # Copies first: of each distinct vector only its k+1 smallest ids can be among anyone's neighbours.  Vectors without a
    # copy are told by their hashes and stay where they are; hot copies are reduced within parts before they meet.
    buckets = repeated_buckets(valid, "h").checkpoint()
    single = valid.withColumn("bucket", _bucket("h")).join(F.broadcast(buckets), "bucket", "left_anti")
    some = valid.withColumn("bucket", _bucket("h")).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
    few = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    copies = some.groupBy("h", "h2").agg(F.min("vec_id").alias("class"), F.count("*").alias("n")).where("n > 1").select("h", "h2", "class").checkpoint()
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).cast("int")
    salted = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    again = some.select("vec_id", "h", "h2", salt.alias("salt")).join(salted, ["h", "h2", "salt"]).select("vec_id", "class").checkpoint()
    parts = again.groupBy("class", F.pmod(F.xxhash64("vec_id"), F.lit(4096)).alias("part")).agg(few.alias("some"))
    ids = parts.select("class", F.explode("some").alias("vec_id")).groupBy("class").agg(few.alias("ids"))
    classes = some.select("vec_id", "vec").join(again.where("vec_id <> class").select("vec_id"), "vec_id", "left_anti").join(ids.withColumnRenamed("class", "vec_id"), "vec_id", "left")
    distinct = single.select("vec_id", F.lit(None).cast("array<long>").alias("ids"), "vec").unionByName(classes.select("vec_id", "ids", "vec"))
    placed = cut_hot(distinct, root)
    stored = placed.select("shard", "vec_id", "ids", "vec").groupBy("shard").applyInArrow(_store(f"{folder}/shards"), "shard long, n long")
    system, path = _system(f"{folder}/shards")
    system.create_dir(path, recursive=True)
    present = np.array(sorted(r["shard"] for r in stored.collect()))
    group = max(1, min(GROUP_SHARDS, len(present) // (3 * spark.sparkContext.defaultParallelism)))
    groups = -(-len(present) // group)
    answers = spark.range(0, groups, 1, groups).mapInArrow(_answer(root, f"{folder}/shards", present, group, k, min_cos, factor), "vec_id long, other_id long, cosine double, several boolean")
    answers.write.parquet(f"{folder}/answers")
    system.delete_dir(path)
    found = spark.read.parquet(f"{folder}/answers")
    best = found.where("several").groupBy(F.col("vec_id").alias("class")).agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other_id"))).alias("ids"))
    each = best.join(again, "class").select("vec_id", "ids")
    wanted = each.select("vec_id", F.explode(F.slice(F.filter("ids", lambda e: e["other_id"] != F.col("vec_id")), 1, k)).alias("e"))
    shared = wanted.select("vec_id", F.col("e.other_id").alias("other_id"), (-F.col("e.far")).alias("cosine"))
    return found.where("NOT several").select("vec_id", "other_id", "cosine").unionByName(shared)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of chunks with cosine 0.80 or more of which one is among the other's five most similar."""
    shared_folder(spark)
    given = table(spark, directory, "chunks").where(F.col("chunk_id").isNotNull()).select("chunk_id", "vec_q", "vec_s", "indexed_at").withColumn("bucket", _bucket("chunk_id"))
    # Chunks delivered once need no shuffle; all others, and the few that share a bucket with one, are cleaned as usual.
    buckets = repeated_buckets(given, "chunk_id").checkpoint()
    once = given.join(F.broadcast(buckets), "bucket", "left_anti").select("chunk_id", "vec_q", "vec_s")
    several = latest(given.join(F.broadcast(buckets), "bucket", "left_semi"), "chunk_id", ["vec_q", "vec_s"], "indexed_at")
    chunks = once.unionByName(several)
    vectors = chunks.where((F.col("vec_s") > 0) & F.col("vec_q").isNotNull()).select(F.col("chunk_id").alias("vec_id"), F.col("vec_q").alias("vec"))
    found = similar_vectors(vectors)
    return found.select(F.least("vec_id", "other_id").alias("chunk_a"), F.greatest("vec_id", "other_id").alias("chunk_b")).distinct()


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
