"""Graph analytics on edge tables, many graphs (repositories) at once."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAMPING, ITERATIONS, TOLERANCE = 0.85, 40, 1e-6
# Rounds between two writes that cut the lineage.
_ROUNDS = 5
# Edges of one graph that a single task may hold; larger graphs are first shrunk by distributed moves.
LOCAL_EDGES = 2_000_000


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(repo_id, node, rank): weighted PageRank of each repository, the highest rank being 1.

    nodes: repo_id, node.  edges: repo_id, src, dst, weight.  Nodes without weight to give spread theirs evenly.
    Ends after `iterations`, or when no repository changes by `tolerance` in all.
    """
    out = edges.groupBy("repo_id", "src").agg(F.sum("weight").alias("out"))
    shares = edges.join(out.where("out > 0"), ["repo_id", "src"]).select("repo_id", "src", "dst", (F.col("weight") / F.col("out")).alias("share")).checkpoint()
    size = nodes.groupBy("repo_id").agg(F.count("*").alias("n"))
    base = nodes.join(size, "repo_id").join(out.where("out > 0").select("repo_id", F.col("src").alias("node"), F.lit(1).alias("gives")), ["repo_id", "node"], "left").select(
        "repo_id", "node", "n", F.col("gives").isNull().alias("dangling")).checkpoint()
    rank = base.select("repo_id", "node", "n", "dangling", (1.0 / F.col("n")).alias("rank"))
    for i in range(iterations):
        given = rank.select("repo_id", F.col("node").alias("src"), "rank").join(shares, ["repo_id", "src"]).groupBy("repo_id", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = rank.where("dangling").groupBy("repo_id").agg(F.sum("rank").alias("lost"))
        fresh = base.join(given, ["repo_id", "node"], "left").join(lost, "repo_id", "left").select(
            "repo_id", "node", "n", "dangling",
            (DAMPING * F.coalesce("got", F.lit(0.0)) + (1 - DAMPING) / F.col("n") + DAMPING * F.coalesce("lost", F.lit(0.0)) / F.col("n")).alias("rank"))
        if (i + 1) % _ROUNDS == 0 and i + 1 < iterations:
            fresh = fresh.checkpoint()
            if tolerance > 0:
                before = rank.select("repo_id", "node", F.col("rank").alias("old"))
                worst = fresh.join(before, ["repo_id", "node"]).groupBy("repo_id").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).agg(F.max("d")).first()[0]
                if worst is None or worst < tolerance:
                    rank = fresh
                    break
        rank = fresh
    top = rank.groupBy("repo_id").agg(F.max("rank").alias("top"))
    return rank.join(top, "repo_id").select("repo_id", "node", (F.col("rank") / F.greatest("top", F.lit(1e-12))).alias("rank"))


def symbol_rank(symbols: DataFrame, edges: DataFrame, file_rank: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, rank): over the edges into a symbol, 0.2 within a file and 1 across, times the caller's file rank plus
    1/number of files; plus 0.05 of its own file's rank."""
    size = files.groupBy("repo_id").agg(F.count("*").alias("n"))
    placed = symbols.select("symbol_id", "file_id").join(file_rank.select(F.col("node").alias("file_id"), "rank", "repo_id"), "file_id").join(size, "repo_id")
    src = placed.select(F.col("symbol_id").alias("src"), F.col("file_id").alias("src_file"), F.col("rank").alias("src_rank"), F.col("n"))
    dst = placed.select(F.col("symbol_id").alias("dst"), F.col("file_id").alias("dst_file"))
    got = edges.join(src, "src").join(dst, "dst").withColumn("w", F.when(F.col("src_file") == F.col("dst_file"), 0.2).otherwise(1.0)).groupBy("dst").agg(
        F.sum(F.col("w") * (F.col("src_rank") + 1.0 / F.col("n"))).alias("got"))
    return placed.join(got, placed["symbol_id"] == got["dst"], "left").select("symbol_id", (F.coalesce("got", F.lit(0.0)) + F.col("rank") * 0.05).alias("rank"))


def hot(ranks: DataFrame, part: int = 50) -> DataFrame:
    """`ranks` (repo_id, symbol_id, rank) of the symbols whose rank is that of the one at a fiftieth of the descending order, or more; 0 is never hot.

    Ranks are counted by value first, so no task sorts a repository's symbols.
    """
    from pyspark.sql import Window

    values = ranks.groupBy("repo_id", "rank").agg(F.count("*").alias("c"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("rank"))
    upto = values.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = values.groupBy("repo_id").agg(F.sum("c").alias("n"))
    cut = upto.join(total, "repo_id").where(F.col("upto") > F.floor(F.col("n") / part)).groupBy("repo_id").agg(F.max("rank").alias("cut"))
    return ranks.join(cut, "repo_id").where((F.col("rank") >= F.col("cut")) & (F.col("rank") > 0)).select("repo_id", "symbol_id", "rank")


def breadth_first(edges: DataFrame, sources: DataFrame, depth: int, fan_out: int | None = None, targets: DataFrame | None = None, stop_rows: int | None = None) -> DataFrame:
    """(query_id, node, depth, parent, ord): what can be reached from each query's sources, level by level.

    edges: src, dst, ord (the order in which a node's edges are followed).  sources: query_id, node, one row
    each.  Every node is reached once, by the path that a first-in-first-out search would take: `trail` is the
    order of the edges on it.  fan_out: follow only so many edges of each node.  targets (query_id, node): a
    query ends at the level where one of its targets is reached.  stop_rows: stop expanding a query that has
    as many rows.  Sources have depth 0 and no parent.
    """
    from pyspark.sql import Window

    if fan_out:
        edges = edges.withColumn("__k", F.row_number().over(Window.partitionBy("src").orderBy("ord"))).where(F.col("__k") <= fan_out).drop("__k")
    nothing = F.lit(None).cast("long")
    level = sources.select("query_id", F.col("node").cast("long").alias("node"), F.lit(0).alias("depth"), nothing.alias("parent"), nothing.alias("ord"), F.array(F.col("node").cast("long")).alias("trail"))
    done = level
    goal = targets.select("query_id", F.col("node").cast("long").alias("node")) if targets is not None else None
    for d in range(1, depth + 1):
        front = level
        if goal is not None:
            reached = done.where("depth > 0").join(goal, ["query_id", "node"], "left_semi").select("query_id").distinct()
            front = front.join(reached, "query_id", "left_anti")
        if stop_rows:
            full = done.where("depth > 0").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= stop_rows).select("query_id")
            front = front.join(full, "query_id", "left_anti")
        step = front.select("query_id", F.col("node").alias("src"), "trail").join(edges.select("src", "dst", "ord"), "src")
        new = step.join(done.select("query_id", F.col("node").alias("dst")), ["query_id", "dst"], "left_anti")
        best = new.groupBy("query_id", F.col("dst").cast("long").alias("node")).agg(F.min(F.struct(F.concat("trail", F.array(F.col("ord").cast("long"))).alias("trail"), F.col("src").cast("long").alias("src"), F.col("ord").cast("long").alias("ord"))).alias("b"))
        level = best.select("query_id", "node", F.lit(d).alias("depth"), F.col("b.src").alias("parent"), F.col("b.ord").alias("ord"), F.col("b.trail").alias("trail")).checkpoint()
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def shortest_paths(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, hop, from_node, to_node, ord): the edges of the path to each query's first reached target, in order."""
    ends = reached.where("depth > 0").join(targets, ["query_id", "node"], "left_semi")
    first = ends.groupBy("query_id").agg(F.min(F.struct("depth", "trail", "node")).alias("e")).select("query_id", F.col("e.node").alias("node"), F.col("e.depth").alias("hop"))
    here, hops = first, None
    longest = first.agg(F.max("hop")).first()[0] or 0
    links = reached.select("query_id", "node", "parent", "ord")
    for _ in range(longest):
        step = here.join(links, ["query_id", "node"]).where(F.col("parent").isNotNull()).select("query_id", "hop", F.col("parent").alias("from_node"), F.col("node").alias("to_node"), "ord")
        hops = step if hops is None else hops.unionByName(step)
        here = step.select("query_id", F.col("from_node").alias("node"), (F.col("hop") - 1).alias("hop"))
    return hops if hops is not None else first.select("query_id", "hop", F.col("node").alias("from_node"), F.col("node").alias("to_node"), F.lit(0).cast("long").alias("ord")).limit(0)


# Modularity that a move, and a level, must add to count.
_LEAST_MOVE, _LEAST_LEVEL = 1e-10, 1e-6


def _settled(start: np.ndarray, near: np.ndarray, weight: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """The community of each node once no single move raises the modularity: nodes wait in a queue, and a node that
    moves calls back those of its neighbours that are not in its new community."""
    whole = float(degree.sum())
    home, volume = np.arange(len(degree)).tolist(), degree.tolist()
    waiting, queue = bytearray(b"\1" * len(home)), deque(range(len(home)))
    while queue:
        v = queue.popleft()
        waiting[v] = 0
        span = slice(start[v], start[v + 1])
        others, mass = near[span].tolist(), float(degree[v])
        pull: defaultdict[int, float] = defaultdict(float, {home[v]: 0.0})
        for u, w in zip(others, weight[span].tolist(), strict=True):
            pull[home[u]] += w
        volume[home[v]] -= mass
        worth = {c: p - mass * volume[c] / whole for c, p in pull.items()}
        target = max(worth, key=lambda c: (worth[c], -c))
        if worth[target] - worth[home[v]] <= _LEAST_MOVE * whole:
            target = home[v]
        volume[target] += mass
        if target != home[v]:
            home[v] = target
            for u in others:
                if home[u] != target and not waiting[u]:
                    waiting[u] = 1
                    queue.append(u)
    return np.array(home, np.int64)


def louvain(n: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Communities of an undirected weighted graph over 0..n-1, numbered by their smallest node.

    Modularity is raised by moves of single nodes, then the communities become nodes, until a level adds less than
    _LEAST_LEVEL.
    """
    a, b, w = (np.array([e[k] for e in edges], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    member, size, reached = np.arange(n), n, -1.0
    while len(w) and w.sum() > 0:
        apart = a != b
        src, dst = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]])
        by = np.lexsort((dst, src))
        both = np.concatenate([w[apart], w[apart]])[by]
        degree = np.bincount(a, w, size) + np.bincount(b, w, size)
        home = _settled(np.searchsorted(src[by], np.arange(size + 1)), dst[by], both, degree)
        _, home = np.unique(home, return_inverse=True)
        few = int(home.max()) + 1
        pair, at = np.unique(np.minimum(home[a], home[b]) * few + np.maximum(home[a], home[b]), return_inverse=True)
        a, b, w = pair // few, pair % few, np.bincount(at, w)
        volume = np.bincount(home, degree)
        now = float(w[a == b].sum() / w.sum() - (volume**2).sum() / volume.sum() ** 2)
        if now - reached < _LEAST_LEVEL:
            break
        member, reached = home[member], now
        if few == size:
            break
        size = few
    _, first, member = np.unique(member, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[member]


def undirected(edges: DataFrame) -> DataFrame:
    """(repo_id, a, b, weight): both directions of a pair added up, a <= b."""
    return edges.groupBy("repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def _communities_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    nodes = np.unique(np.concatenate([rows["a"], rows["b"]]))
    linked = rows[rows["weight"] > 0].sort_values(["a", "b"])
    a, b = np.searchsorted(nodes, linked["a"]), np.searchsorted(nodes, linked["b"])
    label = louvain(len(nodes), list(zip(a.tolist(), b.tolist(), linked["weight"].tolist(), strict=True)))
    _, first = np.unique(label, return_index=True)
    return pd.DataFrame({"repo_id": key[0], "node": nodes, "community": nodes[first[label]]})


def communities(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(repo_id, node, community): Louvain communities per repository, named by their smallest node.

    A repository of up to local_edges edges is solved by one task.  A larger one is first shrunk: rounds in which
    every node joins the neighbour community with the greatest gain, half of the nodes at a time, until its communities
    have few enough edges between them, or two rounds move nothing any more; then it stays as it is, so no task ever holds
    more.  Isolated nodes are their own community.
    """
    # Weight within a contracted node stays, as an edge to itself: gains depend on it.
    pairs = undirected(edges)
    label = nodes.select("repo_id", "node", F.col("node").alias("community"))
    attempt, sizes = 0, []
    while True:
        large = pairs.where(F.col("a") != F.col("b")).groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") > local_edges).checkpoint()
        sizes.append(large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        if sizes[-1] == 0 or sizes[-3:] == [sizes[-1]] * 3:
            break
        moved = _shrink(pairs.join(large, "repo_id", "left_semi"), attempt)
        label = label.join(moved.withColumnRenamed("community", "to").withColumnRenamed("node", "community"), ["repo_id", "community"], "left").select(
            "repo_id", "node", F.coalesce("to", "community").alias("community")).checkpoint()
        ends = lambda c, name: moved.select("repo_id", F.col("node").alias(c), F.col("community").alias(name))
        joined = pairs.join(ends("a", "x"), ["repo_id", "a"], "left").join(ends("b", "y"), ["repo_id", "b"], "left").select("repo_id", F.coalesce("x", "a").alias("src"), F.coalesce("y", "b").alias("dst"), "weight")
        pairs = undirected(joined).checkpoint()
        attempt += 1
    solved = pairs.join(large, "repo_id", "left_anti").groupBy("repo_id").applyInPandas(_communities_of, "repo_id string, node long, community long")
    last = label.join(solved.select("repo_id", F.col("node").alias("community"), F.col("community").alias("to")), ["repo_id", "community"], "left").select(
        "repo_id", "node", F.coalesce("to", "community").alias("community"))
    least = last.groupBy("repo_id", "community").agg(F.min("node").alias("least"))
    return last.join(least, ["repo_id", "community"]).select("repo_id", "node", F.col("least").alias("community"))


def _shrink(pairs: DataFrame, attempt: int) -> DataFrame:
    """(repo_id, node, community) after one round of simultaneous moves of half of the nodes."""
    both = pairs.select("repo_id", F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(pairs.select("repo_id", F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    degree = both.groupBy("repo_id", "node").agg(F.sum("weight").alias("k"))
    total = degree.groupBy("repo_id").agg(F.sum("k").alias("m2"))
    scored = both.join(degree, ["repo_id", "node"]).join(degree.select("repo_id", F.col("node").alias("other"), F.col("k").alias("other_k")), ["repo_id", "other"]).join(total, "repo_id")
    gain = F.col("weight") - F.col("other_k") * F.col("k") / F.col("m2")
    moves = F.pmod(F.xxhash64("node", F.lit(attempt)), F.lit(2)) == 0
    still = F.pmod(F.xxhash64("other", F.lit(attempt)), F.lit(2)) == 1
    best = scored.where(moves & still & (F.col("node") != F.col("other")) & (gain > 0)).groupBy("repo_id", "node").agg(F.max_by("other", F.struct(gain, -F.col("other"))).alias("community"))
    return degree.select("repo_id", "node").join(best, ["repo_id", "node"], "left").select("repo_id", "node", F.coalesce("community", "node").alias("community"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(repo_id, modularity) of a partition."""
    pairs = undirected(edges)
    of = lambda c, name: label.select("repo_id", F.col("node").alias(c), F.col("community").alias(name))
    met = pairs.join(of("a", "x"), ["repo_id", "a"]).join(of("b", "y"), ["repo_id", "b"])
    inside = met.groupBy("repo_id").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("w"))
    ends = met.select("repo_id", F.col("x").alias("c"), "weight").unionByName(met.select("repo_id", F.col("y").alias("c"), "weight")).groupBy("repo_id", "c").agg(F.sum("weight").alias("k"))
    spread = ends.join(inside, "repo_id").groupBy("repo_id").agg(F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("e"))
    return inside.join(spread, "repo_id").select("repo_id", (F.col("w") / F.col("m") - F.col("e")).alias("modularity"))


def fold_small(label: DataFrame, files: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(repo_id, node, community): communities of fewer than `least` files join the one that most files of their
    directory are in (ties: the smaller), else the one they are linked with most, else their directory's first two
    levels, as negative ids."""
    from pyspark.sql import Window

    from graphlake.functions import paths as P

    sized = label.withColumn("n", F.count("*").over(Window.partitionBy("repo_id", "community")))
    placed = sized.join(files.select(F.col("file_id").alias("node"), P.parent_dir(F.col("path")).alias("dir")), "node")
    big, small = placed.where(F.col("n") >= least), placed.where(F.col("n") < least)
    votes = big.groupBy("repo_id", "dir", "community").agg(F.count("*").alias("v"))
    vote = votes.groupBy("repo_id", "dir").agg(F.max_by("community", F.struct("v", -F.col("community"))).alias("voted"))
    both = edges.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(edges.select("repo_id", F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))
    linked = both.join(big.select("repo_id", F.col("node").alias("other"), "community"), ["repo_id", "other"]).groupBy("repo_id", "node", "community").agg(F.sum("weight").alias("w"))
    link = linked.groupBy("repo_id", "node").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("linked"))
    top = F.array_join(F.slice(F.split("dir", "/"), 1, 2), "/")
    fallback = -1 - F.pmod(F.xxhash64("repo_id", top), F.lit(1 << 40))
    folded = small.join(vote, ["repo_id", "dir"], "left").join(link, ["repo_id", "node"], "left").select("repo_id", "node", F.coalesce("voted", "linked", fallback).alias("community"))
    return big.select("repo_id", "node", "community").unionByName(folded)
