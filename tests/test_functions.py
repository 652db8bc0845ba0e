import pytest
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("path, role", [("watchOS Example/a.swift", "Example"), ("runtime-tests/x.ts", "Test"), ("src/jvmTest/A.kt", "Test"), ("docs/bench/a.py", "Doc"), ("src/a_test.go", "Test"), ("src/a.go", "Core"), ("lib/test_functions.bash", "Core"), ("x/Commit.java", "Core")])
def test_role(spark, path, role):
    p = F.col("p")
    assert one(spark, P.role(p, P.is_test_path(p)), p=path) == role


@pytest.mark.parametrize("path, want", [("a/./b//../c", "a/c"), ("../../x", "x"), ("", ""), ("a/b/..", "a")])
def test_normalize(spark, path, want):
    assert one(spark, P.normalize(F.col("p")), p=path) == want


def test_names(spark):
    assert one(spark, X.tokens(F.col("p")), p="parseHTTPServer_v2 x") == ["parse", "http", "server", "v2", "x"]
    assert one(spark, X.query_words(F.col("p")), p="how are routes registered in the router") == ["routes", "registered", "router"]
    assert [one(spark, X.looks_like_symbol(F.col("p")), p=q) for q in ("parseConfig", "a::B", "_x", "route", "two words", "")] == [True, True, True, False, False, False]
    assert one(spark, P.strip_ext(F.col("p")), p="a.b/c.test.ts") == "a.b/c"
    assert one(spark, P.pretty_dir(F.col("p")), p="tokio/src/a/b/c") == "…/a/b/c"
    assert one(spark, P.language(F.col("p")), p="x/y.d.ts") == "TypeScript"
    assert one(spark, P.language(F.col("p")), p="Makefile") is None
    assert one(spark, X.remote_to_web(F.col("p")), p="https://me:pw@host/o/r.git") == "https://host/o/r"
    assert one(spark, X.remote_to_web(F.col("p")), p="git@host:o/r.git") == "https://host/o/r"
    assert one(spark, X.mentions(F.col("p")), p="see `a/B.py:12`, pkg.mod and http://x") == ["a/b.py", "pkg/mod"]
    assert one(spark, P.path_mention(F.col("p"), F.col("m")), p="django/db/query.py", m="db/query") == 0.8
    assert one(spark, X.tokens(F.col("p")), p=None) is None
