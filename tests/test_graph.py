import random
from collections import deque

from hypothesis import given, settings
from hypothesis import strategies as st

from graphlake.operators import graph as G


def test_two_cliques_are_two_communities():
    edges = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4, 0.1)]
    label = G.louvain(8, edges).tolist()
    assert label == [0, 0, 0, 0, 1, 1, 1, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=30))
def test_louvain_is_no_worse_than_singletons(pairs):
    edges = [(min(a, b), max(a, b), 1.0) for a, b in set(pairs) if a != b]

    def modularity(label):
        m = sum(w for *_, w in edges) or 1
        degree = [0.0] * 10
        for a, b, w in edges:
            degree[a] += w
            degree[b] += w
        return sum(w for a, b, w in edges if label[a] == label[b]) / m - sum((sum(degree[i] for i in range(10) if label[i] == c) / (2 * m)) ** 2 for c in set(label))

    assert modularity(G.louvain(10, edges).tolist()) >= modularity(list(range(10))) - 1e-9


def test_pagerank_of_a_star_and_ties(spark):
    nodes = spark.createDataFrame([("r", i) for i in range(4)], "repo_id string, node int")
    edges = spark.createDataFrame([("r", 1, 0, 1.0), ("r", 2, 0, 1.0), ("r", 3, 0, 1.0)], "repo_id string, src int, dst int, weight double")
    rank = {r["node"]: r["rank"] for r in G.pagerank(nodes, edges).collect()}
    assert rank[0] == 1.0 and rank[1] == rank[2] == rank[3] < 1
    assert G.pagerank(nodes.limit(0), edges.limit(0), 2).count() == 0


def fifo(edges, start, depth):
    out, queue, seen = {}, deque([(start, 0)]), {start}
    while queue:
        u, d = queue.popleft()
        if d >= depth:
            continue
        for v, o in sorted(edges.get(u, []), key=lambda e: e[1]):
            if v not in seen:
                seen.add(v)
                out[v] = (d + 1, u, o)
                queue.append((v, d + 1))
    return out


def test_breadth_first_follows_fifo_order(spark):
    rng = random.Random(5)
    pairs = list({(rng.randrange(25), rng.randrange(25)) for _ in range(70)})
    rows = [(a, b, k) for k, (a, b) in enumerate(pairs)]
    near = {}
    for a, b, k in rows:
        near.setdefault(a, []).append((b, k))
    df = spark.createDataFrame(rows, "src long, dst long, ord long")
    starts = spark.createDataFrame([(q, q) for q in (0, 3)], "query_id long, node long")
    got = G.breadth_first(df, starts, 4).where("depth > 0").collect()
    for q in (0, 3):
        assert {r["node"]: (r["depth"], r["parent"], r["ord"]) for r in got if r["query_id"] == q} == fifo(near, q, 4)


def test_shortest_path_edges(spark):
    df = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (1, 4, 2), (4, 3, 3), (3, 1, 4)], "src long, dst long, ord long")
    goal = spark.createDataFrame([(1, 3)], "query_id long, node long")
    reached = G.breadth_first(df, spark.createDataFrame([(1, 1)], "query_id long, node long"), 5, targets=goal)
    assert sorted((r["hop"], r["from_node"], r["to_node"]) for r in G.shortest_paths(reached, goal).collect()) == [(1, 1, 2), (2, 2, 3)]


def test_large_graphs_are_shrunk_first(spark):
    edges = [("r", a, b, 1.0) for g in range(6) for a in range(g * 6, g * 6 + 6) for b in range(g * 6, g * 6 + 6) if a < b] + [("r", g * 6, (g * 6 + 6) % 36, 0.05) for g in range(6)]
    df = spark.createDataFrame(edges, "repo_id string, src long, dst long, weight double")
    nodes = spark.createDataFrame([("r", i) for i in range(37)], "repo_id string, node long")
    small, large = (G.communities(nodes, df, n) for n in (10_000, 20))
    assert {r["node"]: r["community"] for r in small.collect()} == {i: i // 6 * 6 if i < 36 else 36 for i in range(37)}
    assert large.count() == 37 and G.modularity(df, large).first()["modularity"] > 0.5
