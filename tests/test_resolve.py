from graphlake.functions import paths as P
from graphlake.operators import resolve as R
from pyspark.sql import functions as F


def files(spark, paths):
    df = spark.createDataFrame([("r", i, p) for i, p in enumerate(paths)], "repo_id string, file_id int, path string")
    return df.withColumn("lang", P.language(F.col("path"))).withColumn("is_test", P.is_test_path(F.col("path")))


def links(spark, paths, imports):
    df = spark.createDataFrame([("r", paths.index(p), s) for p, s in imports], "repo_id string, file_id int, spec string")
    return sorted((paths[r["src"]], paths[r["dst"]]) for r in R.resolve_imports(files(spark, paths), df).collect())


def test_imports_of_each_language(spark):
    cases = [
        (["src/a/x.ts", "src/b/y.ts", "src/b/index.js", "src/z.tsx", "src/w.ts"], [("src/a/x.ts", "../b/y"), ("src/a/x.ts", "../b"), ("src/a/x.ts", "@/z"), ("src/a/x.ts", "../w.js"), ("src/a/x.ts", "left-pad")],
         ["src/b/y.ts", "src/b/index.js", "src/z.tsx", "src/w.ts"]),
        (["pkg/a.py", "pkg/b.py", "pkg/sub/__init__.py", "lib/deep/mod/util.py"], [("pkg/a.py", ".b"), ("pkg/a.py", "pkg.sub"), ("pkg/a.py", "mod.util"), ("pkg/a.py", "os")], ["pkg/b.py", "pkg/sub/__init__.py", "lib/deep/mod/util.py"]),
        (["cmd/main.go", "internal/core/a.go", "internal/core/b.go", "internal/core/a_test.go"], [("cmd/main.go", "example.org/x/internal/core")], ["internal/core/a.go", "internal/core/b.go"]),
        (["src/lib.rs", "src/a.rs", "src/b/mod.rs", "src/b/c.rs"], [("src/a.rs", "crate::b::c::Thing"), ("src/a.rs", "crate::b"), ("src/b/mod.rs", "self::c"), ("src/b/c.rs", "super::super::a"), ("src/lib.rs", "mod:a")], None),
        (["app/Main.java", "app/src/org/x/Util.java"], [("app/Main.java", "org.x.Util"), ("app/Main.java", "org.x.*")], ["app/src/org/x/Util.java"]),
        (["a/m.c", "a/u.h", "b/u.h", "inc/deep/v.h"], [("a/m.c", "u.h"), ("a/m.c", "deep/v.h")], ["a/u.h", "inc/deep/v.h"]),
    ]
    for paths, imports, wanted in cases:
        got = links(spark, paths, imports)
        if wanted is not None:
            assert sorted(d for _, d in got) == sorted(wanted), got
        else:
            assert got == [("src/a.rs", "src/b/c.rs"), ("src/a.rs", "src/b/mod.rs"), ("src/b/c.rs", "src/a.rs"), ("src/b/mod.rs", "src/b/c.rs"), ("src/lib.rs", "src/a.rs")]


SYMBOLS = "repo_id string, symbol_id int, file_id int, name string, kind string, owner string"
CALLS = "repo_id string, call_id long, file_id int, from_symbol int, name string, line int, heritage boolean, qual string, is_member boolean"


def test_ladder(spark):
    f = files(spark, ["a/x.py", "a/y.py", "b/z.py"])
    symbols = spark.createDataFrame([
        ("r", 1, 0, "go", "function", None), ("r", 2, 0, "Run", "class", None), ("r", 3, 0, "step", "method", "Run"), ("r", 4, 1, "step", "method", "Walk"), ("r", 5, 2, "step", "function", None),
        ("r", 6, 1, "alone", "function", None), ("r", 7, 1, "get", "method", "Walk"), ("r", 8, 2, "Base", "class", None)], SYMBOLS)
    calls = spark.createDataFrame([
        ("r", 1, 0, 1, "step", 5, False, "self", True), ("r", 2, 0, 1, "step", 6, False, "Walk", True), ("r", 3, 0, 1, "alone", 7, False, None, False), ("r", 4, 0, 1, "get", 8, False, "x", True),
        ("r", 5, 0, 2, "Base", 1, True, None, False), ("r", 6, 0, 1, "alone", 9, False, None, False), ("r", 7, 0, None, "alone", 20, False, None, False), ("r", 8, 0, 1, "go", 2, False, None, False)], CALLS)
    imports = spark.createDataFrame([("r", 0, 1)], "repo_id string, src int, dst int")
    found = R.resolve_calls(f, symbols, calls, imports)
    edges = sorted((r["src"], r["dst"], r["kind"], r["line"]) for r in R.symbol_edges(found).collect())
    assert edges == [(1, 3, "Calls", 5), (1, 4, "Calls", 6), (1, 6, "Calls", 7), (1, 7, "Calls", 8), (2, 8, "Extends", 1)]
    pairs = {(r["src"], r["dst"]): (r["imports"], r["calls"]) for r in R.file_edges(found, imports).collect()}
    assert pairs == {(0, 1): (1, 5), (0, 2): (0, 1)}


def test_intervals(spark):
    s = spark.createDataFrame([(1, 10, 1, 900, "class"), (1, 11, 5, 9, "method"), (1, 12, 5, 9, "method"), (1, 13, None, 3, "method")], "file_id int, symbol_id int, start_line int, end_line int, kind string")
    points = spark.createDataFrame([(1, 6), (1, 600), (1, 901), (2, 1)], "file_id int, line int")
    assert {(r["file_id"], r["line"]): r["symbol_id"] for r in R.innermost(points, s).collect()} == {(1, 6): 11, (1, 600): 10, (1, 901): None, (2, 1): None}
    hunks = spark.createDataFrame([(1, 8, 300), (1, 100, 200)], "file_id int, first int, last int")
    assert sorted((r["first"], r["symbol_id"]) for r in R.overlapping(hunks, s).collect() if r["symbol_id"]) == [(8, 11), (8, 12)]


def test_targets(spark):
    f = files(spark, ["src/a.py", "tests/test_a.py", "src/deep/only.py"])
    s = spark.createDataFrame([(1, 0, "run", "A", "method", 1, 9), (2, 1, "run", None, "function", 1, 2), (3, 0, "Run", None, "class", 20, 30)], "symbol_id int, file_id int, name string, owner string, kind string, start_line int, end_line int")
    ranks = spark.createDataFrame([(2, 9.0), (1, 0.1)], "symbol_id int, rank double")
    q = spark.createDataFrame([(x,) for x in ("run", "RUN", "A.run", "src/a.py:5", "only.py", "nothing", "  ")], "query string")
    got = {}
    for r in R.resolve_targets(q, f, s, ranks).orderBy("query", "at").collect():
        got.setdefault(r["query"], []).append((r["file_id"], r["symbol_id"]))
    assert got == {"run": [(0, 1), (1, 2)], "RUN": [(0, 1), (0, 3), (1, 2)], "A.run": [(0, 1)], "src/a.py:5": [(0, 1)], "only.py": [(2, None)]}
