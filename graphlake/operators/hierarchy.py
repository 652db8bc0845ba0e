"""Parent-child links to full hierarchies.

Partition-local weighted disjoint sets give every node the end of its chain inside the partition and the
steps to it.  The links that leave a partition are contracted to one row per exit and merged level by level,
each level doubling the distance covered, until a chain ends in a root or is known to run into a circle.  Every
level is a join of the links that are still open; no task holds more than its share of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT, CYCLE, OPEN = 0, 1, 2

_LOCAL = "node long, anchor long, steps long, low long, state int, outside long, path array<long>"


class WeightedForest:
    """Disjoint-set forest over a block of links, with the offset of each node to its representative.

    parent: for each node an index, or -1 where its chain ends.  weight: the length of each link.
    low: the least label on each link, its target excluded.  After `compress`: `top` is the end of the chain,
    `offset` the length up to it; for `circular` nodes, whose chain never ends, `least` is the least label
    on the circle.
    """

    def __init__(self, parent: np.ndarray, weight: np.ndarray, low: np.ndarray):
        n = len(parent)
        here = np.arange(n)
        self.ended = parent < 0
        self.top = np.where(self.ended, here, parent)
        self.offset = np.where(self.ended, 0, weight).astype(np.int64)
        self.low = low.astype(np.int64).copy()
        self.compress()

    def compress(self) -> None:
        n = len(self.top)
        live = np.flatnonzero(~self.ended[self.top]) if n else np.zeros(0, np.int64)
        for _ in range(math.ceil(math.log2(n + 1)) + 1):
            if len(live) == 0:
                break
            hop = self.top[live]
            # All read before any is written: each round doubles what every live node has passed.
            offset, low, top = self.offset[live] + self.offset[hop], np.minimum(self.low[live], self.low[hop]), self.top[hop]
            self.offset[live], self.low[live], self.top[live] = offset, low, top
            live = live[~self.ended[top]]
        self.circular = np.zeros(n, bool)
        self.circular[live] = True
        # Such a node has by now hopped onto the circle, and what is kept there has gone all around it.
        self.least = self.low[self.top] if n else self.low


def _paths(parent: np.ndarray, offset: np.ndarray, label: np.ndarray, skip: np.ndarray) -> list:
    """The labels from the end of each chain down to the node; None where skip."""
    out: list = [None] * len(parent)
    for i in np.argsort(offset, kind="stable"):
        if not skip[i]:
            p = parent[i]
            out[i] = [int(label[i])] if p < 0 else [*out[p], int(label[i])]
    return out


def _local(with_path: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        block = pd.concat(frames, ignore_index=True).sort_values("node", kind="stable")
        node = block["node"].to_numpy(np.int64)
        has = block["parent"].notna().to_numpy()
        parent = block["parent"].where(has, -1).to_numpy(np.int64)
        at = np.minimum(np.searchsorted(node, parent), len(node) - 1)
        inside = has & (node[at] == parent)
        index = np.where(inside, at, -1)
        forest = WeightedForest(index, np.ones(len(node), np.int64), node)
        top = forest.top
        state = np.where(forest.circular, CYCLE, np.where((has & ~inside)[top], OPEN, ROOT))
        path = _paths(index, forest.offset, node, forest.circular) if with_path else [None] * len(node)
        low = np.minimum(forest.low, node[top])
        yield pd.DataFrame({
            "node": node, "anchor": np.where(forest.circular, forest.least, node[top]), "steps": forest.offset, "low": low,
            "state": state.astype(np.int32), "outside": np.where(state == OPEN, parent[top], -1), "path": path})

    return run


def _merge_levels(contracted: DataFrame) -> DataFrame:
    """(node, anchor, steps, state, path) of contracted links (also low), none of them OPEN any more.

    A chain that is open after as many doublings as cover all links that were open before the last one has no end:
    it is on a circle, or leads to one, that has been gone around.
    """
    ended = contracted.where(F.col("state") != OPEN)
    opened = contracted.where(F.col("state") == OPEN)
    covered, left = 1, opened.count()
    while left:
        far = ended.unionByName(opened).select(F.col("node").alias("anchor"), *[F.col(c).alias(f"far_{c}") for c in ("anchor", "steps", "low", "state", "path")])
        hopped = opened.join(far, "anchor").select(
            "node", F.col("far_anchor").alias("anchor"), (F.col("steps") + F.col("far_steps")).alias("steps"), F.least("low", "far_low").alias("low"),
            F.col("far_state").alias("state"), F.concat("far_path", "path").alias("path")).checkpoint()
        ended = ended.unionByName(hopped.where(F.col("state") != OPEN))
        opened = hopped.where(F.col("state") == OPEN)
        enough, covered, left = covered >= left, 2 * covered, opened.count()
        if enough:
            break
    around = opened.select(F.col("node").alias("anchor"), F.col("low").alias("least"))
    circles = opened.join(around, "anchor").select("node", F.col("least").alias("anchor"), "steps", F.lit(CYCLE).alias("state"), F.lit(None).cast("array<long>").alias("path"))
    return ended.select("node", "anchor", "steps", "state", "path").unionByName(circles) if left else ended.select("node", "anchor", "steps", "state", "path")


def hierarchy(links: DataFrame, node: str, parent: str, near: str | None = None, paths: bool = True) -> DataFrame:
    """The place of each node in its tree: (node, root_id, depth, path, in_cycle).

    links: one row per node.  A null parent, or one without a row, makes the node a root.  near: a column in
    which linked nodes mostly agree (their file, say): links within a partition are followed without a shuffle.
    root_id: the root, or the smallest node on the circle that the chain runs into.  depth: links up to the
    root, and path: the nodes from the root down to the node; both null where in_cycle (the chain never ends).
    paths=False leaves path null.  Rows with a null node are left out; repeated rows must be removed before.
    An empty table gives an empty result.  Other columns are not looked at, whatever their names.
    """
    base = links.where(F.col(node).isNotNull()).select(
        F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"), (F.col(near) if near else F.col(node)).alias("near"))
    # Ranges, not hashes: neighbours stay together, and one huge `near` value is spread over several partitions.
    ranged = base.repartitionByRange(F.col("near"), F.col("node")).select("node", "parent")
    # Read by every level: written once to the folder that all executors share.
    local = ranged.mapInPandas(_local(paths), _LOCAL).checkpoint()
    exits = local.where((F.col("state") == OPEN) & (F.col("node") == F.col("anchor"))).select(F.col("node").alias("exit"), "outside")
    reached = exits.join(local.drop("outside"), F.col("outside") == F.col("node"))
    found = reached.select(
        F.col("exit").alias("node"), "anchor", (F.col("steps") + 1).alias("steps"), F.least("exit", "low").alias("low"), "state", "path")
    # Links that lead to no row: the exit is a root itself.
    lost = exits.join(found.select(F.col("node").alias("exit")), "exit", "left_anti").select(
        F.col("exit").alias("node"), F.col("exit").alias("anchor"), F.lit(0).cast("long").alias("steps"), F.col("exit").alias("low"),
        F.lit(ROOT).alias("state"), F.array().cast("array<long>").alias("path"))
    contracted = found.unionByName(lost).checkpoint()
    up = _merge_levels(contracted).select(F.col("node").alias("anchor"), F.col("anchor").alias("up_anchor"), F.col("steps").alias("up_steps"), F.col("state").alias("up_state"), F.col("path").alias("up_path"))
    inner = local.where(F.col("state") != OPEN).select("node", "anchor", "steps", "state", "path")
    outer = local.where(F.col("state") == OPEN).join(up, "anchor").select(
        "node", F.col("up_anchor").alias("anchor"), (F.col("steps") + F.col("up_steps")).alias("steps"), F.col("up_state").alias("state"),
        F.concat("up_path", "path").alias("path"))
    every = inner.unionByName(outer)
    circular = F.col("state") == CYCLE
    return every.select(
        F.col("node").alias(node), F.col("anchor").alias("root_id"), F.when(~circular, F.col("steps")).alias("depth"),
        F.when(~circular, F.col("path")).alias("path"), circular.alias("in_cycle"))


def descendants(tree: DataFrame, node: str) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every node and each node above it, from `hierarchy`'s paths."""
    steps = tree.where(~F.col("in_cycle")).select(F.col(node).alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return steps.where(F.col("at") < F.col("depth")).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(tree: DataFrame, node: str) -> DataFrame:
    """`tree`, from `hierarchy` with paths, with n_descendants: the nodes below each node; null where in_cycle.

    Every node holds the count of those up to a distance below it and the node that far above it; each round adds the
    counts of the nodes just beyond and doubles the distance, so deep chains cost their depth's logarithm in rounds and
    no row per node and ancestor.
    """
    above = F.when(F.col("depth") > 0, F.get("path", F.col("depth").cast("int") - 1))
    held = tree.where(~F.col("in_cycle")).select(F.col(node).alias("v"), above.alias("up"), F.lit(1).cast("long").alias("n")).checkpoint()
    while not held.where(F.col("up").isNotNull()).isEmpty():
        more = held.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("v")).agg(F.sum("n").alias("more"))
        far = held.select(F.col("v").alias("up"), F.col("up").alias("far"))
        held = held.join(more, "v", "left").select("v", "up", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).join(far, "up", "left").select("v", F.col("far").alias("up"), "n").checkpoint()
    counts = held.select(F.col("v").alias(f"{node}__v"), (F.col("n") - 1).alias("n_descendants"))
    return tree.join(counts, tree[node] == counts[f"{node}__v"], "left").select(*tree.columns, "n_descendants")


def _circular(tree: DataFrame, links: DataFrame, node: str, parent: str) -> DataFrame:
    """(v, up, root_id): the links of all nodes whose way up never ends."""
    ends = tree.where("in_cycle").select(F.col(node).alias("v"), "root_id")
    return links.where(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("v"), F.col(parent).cast("long").alias("up")).join(ends, "v").checkpoint()


def _twice(hop: DataFrame) -> DataFrame:
    """(v, up) twice as far up."""
    return hop.join(hop.select(F.col("v").alias("up"), F.col("up").alias("far")), "up").select("v", F.col("far").alias("up")).checkpoint()


def circles(tree: DataFrame, links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, parent, root_id): the links that go in circles, without those that only lead to one; root_id as in `hierarchy`.

    Going up from all nodes at once ends on the circles: the distance doubles until no fewer nodes are reached than before.
    """
    ways = _circular(tree, links, node, parent)
    hop = ways.select("v", "up")
    before, now = ways.count(), hop.select("up").distinct().count()
    while now < before:
        hop = _twice(hop)
        before, now = now, hop.select("up").distinct().count()
    on = hop.select(F.col("up").alias("v")).distinct()
    return ways.join(on, "v").select(F.col("v").alias(node), F.col("up").alias(parent), "root_id")


def circle_descendants(tree: DataFrame, links: DataFrame, node: str, parent: str) -> DataFrame:
    """As `descendants`, for the nodes that it leaves out: those on circles and those whose way up leads to one.

    No node is above itself; the others of a circle are above and below each other, at the least distance.
    """
    hop = _circular(tree, links, node, parent).select("v", "up")
    pairs = hop.where("v <> up").select(F.col("up").alias("ancestor_id"), F.col("v").alias("descendant_id"), F.lit(1).cast("long").alias("distance"))
    covered, known = 1, pairs.count()
    while True:
        ahead = pairs.select("ancestor_id", F.col("descendant_id").alias("up"), (F.col("distance") + covered).alias("distance"))
        beyond = hop.join(ahead, "up").select("ancestor_id", F.col("v").alias("descendant_id"), "distance").where("ancestor_id <> descendant_id")
        pairs = pairs.unionByName(beyond).groupBy("ancestor_id", "descendant_id").agg(F.min("distance").alias("distance")).checkpoint()
        before, known = known, pairs.count()
        if known == before:
            return pairs
        hop, covered = _twice(hop), 2 * covered


CONTAINERS = ("class", "struct", "interface", "trait", "enum", "module")


def symbol_links(symbols: DataFrame) -> DataFrame:
    """(symbol_id, file_id, parent): `parent` of each symbol, or, where it is null, the owner in the same file.

    The owner is the one symbol of that file with the name in `owner` and a container kind; none if there are
    several or no name.  Rows delivered twice count once.
    """
    fields = F.struct("indexed_at", "file_id", "name", "kind", "owner", "parent")
    one = symbols.where(F.col("symbol_id").isNotNull()).groupBy("symbol_id").agg(F.max(fields).alias("s")).select("symbol_id", "s.*")
    owners = one.where(F.col("kind").isin(*CONTAINERS) & F.col("name").isNotNull()).groupBy("file_id", F.col("name").alias("owner")).agg(
        F.min("symbol_id").alias("owner_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    wanting = one.where(F.col("parent").isNull() & F.col("owner").isNotNull()).select("symbol_id", "file_id", "owner")
    by_owner = wanting.join(owners, ["file_id", "owner"]).select("symbol_id", "owner_id")
    return one.join(by_owner, "symbol_id", "left").select("symbol_id", "file_id", F.coalesce("parent", "owner_id").alias("parent"))
