import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphlake.operators import hierarchy as H


def brute(parent):
    out = {}
    for v in parent:
        seen, at = [v], v
        while True:
            up = parent[at]
            if up is None or up not in parent:
                out[v] = (at, len(seen) - 1, list(reversed(seen)), False)
                break
            if up in seen:
                out[v] = (min(seen[seen.index(up) :]), None, None, True)
                break
            seen.append(up)
            at = up
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 24)), min_size=1, max_size=20))
def test_forest_in_one_block(links):
    import pandas as pd

    parent = dict(enumerate(links))
    block = pd.DataFrame({"node": list(parent), "parent": [None if p is None else float(p) for p in parent.values()]})
    got = next(H._local(True)(iter([block])))
    want = brute({k: (v if v in parent else None) for k, v in parent.items()})
    for _, r in got.iterrows():
        root, depth, path, circular = want[r["node"]]
        if r["state"] == H.CYCLE:
            assert circular and r["anchor"] == root
        elif r["state"] == H.ROOT:
            assert (r["anchor"], r["steps"], list(r["path"])) == (root, depth, path)
        else:
            assert not circular and r["anchor"] == root and r["outside"] == parent[r["anchor"]]


def run(spark, parent, near=None, paths=True):
    rows = [(k, v, (near or {}).get(k, k)) for k, v in parent.items()]
    df = spark.createDataFrame(rows, "id long, up long, near long")
    return {r["id"]: (r["root_id"], r["depth"], r["path"], r["in_cycle"]) for r in H.hierarchy(df, "id", "up", "near", paths).collect()}


def test_across_partitions_matches_brute_force(spark):
    rng = random.Random(3)
    parent = {i: (None if rng.random() < 0.05 else rng.randrange(300)) for i in range(280)}
    near = {i: rng.randrange(5) for i in parent}
    assert run(spark, parent, near) == {k: (a, b, c, d) for k, (a, b, c, d) in brute({k: (v if v in parent else None) for k, v in parent.items()}).items()}


def test_distributed_merge_matches(spark):
    parent = {i: i - 1 if i else None for i in range(40)} | {100: 101, 101: 102, 102: 100, 103: 100}
    near = {i: i * 7919 % 13 for i in parent}
    assert run(spark, parent, near) == brute(parent)


def test_edges_of_input(spark):
    assert run(spark, {}) == {}
    assert run(spark, {1: 1, 2: None, 3: 99}) == {1: (1, None, None, True), 2: (2, 0, [2], False), 3: (3, 0, [3], False)}
    df = spark.createDataFrame([(1, None, "x", 5), (None, 1, "y", 6)], "id long, up long, path string, depth int")
    assert [tuple(r)[:3] for r in H.hierarchy(df, "id", "up").collect()] == [(1, 1, 0)]  # null nodes are left out, clashing names unread


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], "id long, up long")
    tree = H.hierarchy(df, "id", "up")
    assert sorted(map(tuple, H.descendants(tree, "id").collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert {r["id"]: r["n_descendants"] for r in H.descendant_counts(tree, "id").collect()} == {1: 2, 2: 1, 3: 0, 4: None}


def test_descendants_of_chains_and_stars(spark):
    parent = {0: None} | {i: i - 1 for i in range(1, 70)} | {i: 5 for i in range(100, 160)} | {200: 201, 201: 200, 202: 200}
    df = spark.createDataFrame(list(parent.items()), "id long, up long")
    got = {r["id"]: r["n_descendants"] for r in H.descendant_counts(H.hierarchy(df, "id", "up"), "id").collect()}
    want = {v: None if v >= 200 else 0 for v in parent}
    for v in parent:
        at = parent[v]
        while v < 200 and at is not None:
            want[at] += 1
            at = parent[at]
    assert got == want


def test_circles_and_what_is_below_each_node(spark):
    parent = {0: None, 1: 0, 2: 1, 3: 99, 5: 5, 6: 5, 7: 6, 10: 11, 11: 10, 12: 10} | {20 + i: 20 + (i + 1) % 7 for i in range(7)} | {30: 23} | {30 + i: 29 + i for i in range(1, 20)}
    links = spark.createDataFrame([*parent.items(), (None, 5)], "id int, up int")
    tree = H.hierarchy(links, "id", "up")
    above = {}
    for v in parent:
        at, steps = parent[v], 1
        while at in parent and at != v and (at, v) not in above:
            above[at, v] = steps
            at, steps = parent[at], steps + 1
    got = [tuple(r) for r in H.descendants(tree, "id").unionByName(H.circle_descendants(tree, links, "id", "up")).collect()]
    assert len(got) == len(above) and {(a, d): n for a, d, n in got} == above
    want = [(5, 5, 5), (10, 11, 10), (11, 10, 10)] + [(20 + i, 20 + (i + 1) % 7, 20) for i in range(7)]
    assert sorted(map(tuple, H.circles(tree, links, "id", "up").collect())) == want
    some = links.where("id < 4")
    assert H.circles(H.hierarchy(some, "id", "up"), some, "id", "up").count() == H.circle_descendants(H.hierarchy(some, "id", "up"), some, "id", "up").count() == 0


def test_circles_of_many_lengths_over_partitions(spark):
    parent, at = {}, 0
    for length in (1, 2, 3, 5, 8, 13, 31):
        parent |= {at + i: at + (i + 1) % length for i in range(length)} | {at + 500 + i: at + i % length for i in range(4)} | {at + 700: at + 500}
        at += length
    near = {i: i * 7919 % 17 for i in parent}
    assert run(spark, parent, near) == brute(parent)


def test_owner_is_used_only_without_parent(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    schema = "symbol_id int, file_id int, name string, kind string, owner string, parent int, indexed_at timestamp"
    rows = [
        (1, 1, "A", "class", None, None, t), (2, 1, "m", "method", "A", None, t), (3, 1, "n", "method", "A", 77, t), (4, 1, "B", "class", "B", None, t), (5, 1, "o", "method", "C", None, t),
        (6, 2, "D", "class", None, None, t), (7, 2, "D", "struct", None, None, t), (8, 2, "p", "method", "D", None, t), (2, 1, "m", "method", "A", None, datetime(2024, 2, 1)), (None, 1, "x", "class", None, None, t)]
    got = {r["symbol_id"]: r["parent"] for r in H.symbol_links(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: None, 2: 1, 3: 77, 4: 4, 5: None, 6: None, 7: None, 8: None}
