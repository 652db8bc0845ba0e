from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphlake.functions import text as X
from graphlake.operators import catalog as C
from graphlake.operators import extract as E
from graphlake.operators import metrics as M
from graphlake.operators import search as Q
from graphlake.operators import tools as T
from graphlake.operators import windows as W
from graphlake.operators import workspace as S
from graphlake.sources import repository as R


def test_bm25_keeps_corpus_statistics_under_a_filter(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "b"), (4, "")], "id int, text string").withColumn("ws", X.tokens(F.col("text")))
    post, lengths = Q.postings(docs, "id", "ws"), docs.select("id", F.size("ws").alias("len"))
    terms = Q.query_terms(spark.createDataFrame([(1, "b a a")], "query_id int, text string"))
    every = {r["id"]: r["score"] for r in Q.bm25(post, lengths, terms, "id").collect()}
    some = {r["id"]: r["score"] for r in Q.bm25(post, lengths, terms, "id", spark.createDataFrame([(1,)], "id int")).collect()}
    assert set(every) == {1, 2, 3} and some == {1: every[1]} and max(every, key=every.get) == 1


def test_dense_ignores_missing_vectors_and_orders_ties(spark):
    v = spark.createDataFrame([(1, [1, 0]), (2, [0, 1]), (3, None), (4, [2, 0]), (5, [0, 0]), (6, [1])], "id int, vec array<int>")
    q = spark.createDataFrame([(9, [1, 0])], "query_id int, vec array<int>")
    assert [r["id"] for r in Q.dense(v, q, "id", 3).orderBy("at").collect()] == [1, 4, 2]


def test_every_fiftieth_vector_is_a_query(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries

    rows = [(i, i % 3, [float((i * j * 7919) % 13 - 6) for j in range(1, 5)]) for i in range(1, 205)]
    spark.createDataFrame([*rows, rows[49], (250, 0, None)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(Q, "DENSE_BLOCK", 3)
    got = {}
    for r in queries()["embedding_topk_batch"](spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    vectors = {i: v for i, _, v in rows if any(v)}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (norm(b) * norm(a))
    assert got == {q: set(sorted(vectors, key=lambda i, q=q: (-cosine(vectors[q], vectors[i]), i))[:5]) for q in (50, 100, 150, 200)}


def test_tuning_passes_over_what_it_does_not_know():
    t = Q.Tuning.read("k=5,cand=7,nope=1,wd=x")
    assert (t.k, t.cand, t.wd) == (5.0, 7, 1.0)


def test_fusion_and_ndcg(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, item string, at int")
    b = spark.createDataFrame([(1, "y", 0)], "query_id int, item string, at int")
    fused = {r["item"]: r["score"] for r in Q.fuse([(a, 1.0), (b, 2.0)], ["item"]).collect()}
    assert fused["y"] == pytest.approx(1 / 21 + 2 / 20)
    gold = spark.createDataFrame([(1, "y"), (2, "z")], "query_id int, item string")
    got = {r["query_id"]: r["ndcg"] for r in M.ndcg(a, gold).collect()}
    assert got[1] == pytest.approx(1 / 1.5849625) and got[2] == 0


def test_budget_percentile_and_runs(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("g", 3, 5)], "g string, i int, c int")
    assert [r["i"] for r in W.within_budget(df, ["g"], [F.asc("i")], F.col("c"), 10).collect()] == [1, 2]
    values = spark.createDataFrame([(float(x),) for x in range(100)] + [(None,)], "v double")
    assert W.percentile_by_index(values, "v", 0.95).first()["p"] == 95.0
    runs = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 3, None), ("g", 4, None), ("g", 5, "a")], "g string, i int, n string")
    assert sorted(r["i"] for r in W.consecutive_distinct(runs, ["g"], [F.asc("i")], ["n"]).collect()) == [1, 3, 5]


def test_python_and_brace_extraction():
    py = E.extract("import os\nfrom .a import b\n\nclass A(Base):\n    def m(self):\n        self.n(1)\n        f(2)\n\ndef g():\n    pass\n", "Python")
    assert [(s["name"], s["kind"], s["owner"], s["parent"], s["start_line"], s["end_line"]) for s in py["symbols"]] == [("A", "class", None, None, 4, 7), ("m", "method", "A", 0, 5, 7), ("g", "function", None, None, 9, 10)]
    assert [(c["name"], c["heritage"], c["qual"], c["from_symbol"]) for c in py["calls"]] == [("Base", True, None, 0), ("n", False, "self", 1), ("f", False, None, 1)]
    assert py["imports"] == [".a", "os"]
    js = E.extract('import x from "./y";\nclass A extends B {\n  run(a) {\n    this.go("}");\n  }\n}\n', "JavaScript")
    assert [(s["name"], s["start_line"], s["end_line"], s["owner"]) for s in js["symbols"]] == [("A", 2, 6, None), ("run", 3, 5, "A")]
    assert js["imports"] == ["./y"] and ("go", "this") in {(c["name"], c["qual"]) for c in js["calls"]}
    assert E.extract("", "Go") == {"symbols": [], "calls": [], "imports": [], "chunks": []}


def test_extraction_of_further_languages():
    def facts(text, lang):
        got = E.extract(text, lang)
        return {(s["name"], s["kind"], s["owner"], s["start_line"], s["end_line"]) for s in got["symbols"]}, {(c["name"], c["heritage"]) for c in got["calls"]}, got["imports"]

    symbols, calls, imports = facts("using System.Text;\nnamespace Shop\n{\n    public class Cart : Base, IThing\n    {\n        public async Task<int> Add(Item x)\n        {\n            return Total(x);\n        }\n        int Twice(int n) => n * 2;\n    }\n}\n", "CSharp")
    assert {(n, a, b) for n, _, _, a, b in symbols} == {("Shop", 2, 12), ("Cart", 4, 11), ("Add", 6, 9), ("Twice", 10, 10)} and {("Base", True), ("IThing", True), ("Total", False)} <= calls and imports == ["System.Text"]
    symbols, calls, imports = facts("require_relative 'lib/a'\nmodule M\n  class A < B\n    def run!(x)\n      go(x) # end\n    end\n    def self.one; 1; end\n  end\nend\n", "Ruby")
    assert {(n, o, a, b) for n, _, o, a, b in symbols} == {("M", None, 2, 9), ("A", "M", 3, 8), ("run!", "A", 4, 6), ("one", "A", 7, 7)} and {("B", True), ("go", False)} <= calls and imports == ["lib/a"]
    symbols, calls, imports = facts("<?php\nuse App\\Models\\User;\nfinal class A extends B implements C\n{\n    public function run(int $x): int\n    {\n        return $this->go($x);\n    }\n}\nfunction f() { return 1; }\n", "Php")
    assert {(n, k, a, b) for n, k, _, a, b in symbols} == {("A", "class", 3, 9), ("run", "method", 5, 8), ("f", "function", 10, 10)} and {("B", True), ("C", True), ("go", False)} <= calls and imports == ["App\\Models\\User"]
    symbols, calls, imports = facts("import a.b.C\n\nsealed class A(val x: Int) : B(), D {\n    override fun run(\n        y: Int,\n    ): Int {\n        return go(y)\n    }\n    fun twice(n: Int) = n * 2\n}\nfun A.more() = run(1)\n", "Kotlin")
    assert {(n, a, b) for n, _, _, a, b in symbols} == {("A", 3, 10), ("run", 4, 8), ("twice", 9, 9), ("more", 11, 11)} and ("go", False) in calls and ("B", True) in calls and imports == ["a.b.C"]
    assert ("more", "A") in {(n, o) for n, _, o, _, _ in symbols}
    symbols, calls, imports = facts("import UIKit\npublic final class A: B, C {\n    init(x: Int) {\n        go(x)\n    }\n    static func make() -> A {\n        return A(x: 1)\n    }\n}\nprotocol P {\n    func must()\n}\nextension A {\n    func more() {\n    }\n}\n", "Swift")
    assert {(n, o, a, b) for n, _, o, a, b in symbols} == {("A", None, 2, 9), ("init", "A", 3, 5), ("make", "A", 6, 8), ("P", None, 10, 12), ("must", "P", 11, 11), ("more", "A", 14, 15)} and {("B", True), ("C", True), ("go", False)} <= calls and imports == ["UIKit"]


def test_chunks_cover_every_line_with_text():
    text = "x = 1\n" * 70 + "def f():\n" + "    y = 2\n" * 200 + "z = 3\n"
    facts = E.extract(text, "Python")
    covered = {n for c in facts["chunks"] for n in range(c["start_line"], c["end_line"] + 1)}
    assert covered >= set(range(1, 273)) and facts["chunks"][0]["end_line"] == 60


def test_statements_and_parts():
    assert C.statements("a; b 'x;y' ; $$ c; d $$; -- e;\nf (g; h)") == ["a", "b 'x;y'", "$$ c; d $$", "f (g; h)"]
    assert C.parts("a int, b numeric(1, 2), c text default ','") == ["a int", "b numeric(1, 2)", "c text default ','"]


def test_django_forms():
    code = (
        "from django.db import models\nclass Base(models.Model):\n    made = models.DateField()\n    class Meta:\n        abstract = True\nclass Item(Base):\n    tags = models.ManyToManyField('Tag')\n"
        "    user = models.ForeignKey(settings.AUTH_USER_MODEL, on_delete=models.CASCADE)\nclass Tag(models.Model):\n    pass\nclass Toy(Item):\n    pass\nclass Proxy(Tag):\n    class Meta:\n        proxy = True\n")
    tables = C.read_sources([("shop/models.py", code)]).tables
    assert set(tables) == {"shop_item", "shop_item_tags", "shop_tag", "shop_toy"}
    assert [c["name"] for c in tables["shop_item"]["columns"]] == ["id", "made", "user_id"] and tables["shop_toy"]["keys"][0]["ref"] == "shop_item"


def test_sqlite_catalogue(tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE a (id INTEGER PRIMARY KEY, n TEXT NOT NULL); CREATE TABLE b (a_id INTEGER REFERENCES a(id)); CREATE UNIQUE INDEX i ON a (n);")
    a, b = C.sqlite_catalog(path)
    assert a["columns"][0]["primary"] and a["indexes"] == [{"name": "i", "unique": True, "columns": ["n"]}] and b["keys"][0]["ref"] == "a"
    assert "pw" not in C.redact("no postgres://u:pw@h/d pw", "postgres://u:pw@h/d")


def test_packages_between_repositories(spark):
    manifests = spark.createDataFrame([
        ("core", "package.json", '{"name": "@acme/core"}'), ("core", "crate/Cargo.toml", '[package]\nname = "acme-core"\n'), ("app", "package.json", '{"name": "app"}'), ("py", "pyproject.toml", '[project]\nname = "My.Tool"\n'),
        ("x", "node_modules/y/package.json", '{"name": "y"}')], "repo_id string, path string, content string")
    packages = S.published(manifests)
    assert sorted((r["kind"], r["key"]) for r in packages.collect()) == [("cargo", "acme_core"), ("npm", "@acme/core"), ("npm", "app"), ("python", "my_tool")]
    imports = spark.createDataFrame([
        ("app", 1, "TypeScript", "@acme/core/src/greet"), ("app", 1, "TypeScript", "left-pad"), ("app", 2, "Rust", "acme_core::x"), ("app", 3, "Python", "my_tool.sub.mod"), ("app", 3, "Python", "os"), ("core", 4, "TypeScript", "@acme/core")], "repo_id string, file_id int, lang string, spec string")
    edges = S.cross_edges(packages, S.consumed(imports))
    assert sorted((r["from_file"], r["package"], r["sub"]) for r in edges.collect()) == [(1, "@acme/core", "src/greet"), (2, "acme_core", None), (3, "my_tool", "sub/mod")]
    files = spark.createDataFrame([("core", 10, "src/greet.ts"), ("core", 11, "src/util.ts")], "repo_id string, file_id int, path string")
    assert [(r["file_id"], r["from_file"]) for r in S.importers_of(edges, files).collect()] == [(10, 1)]


def test_diffs_references_and_workspaces():
    assert R.hunks("+++ b/a.py\n@@ -1,2 +3,4 @@\n@@ -9 +10,0 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n") == [("a.py", 3, 6), ("a.py", 10, 10)]
    with pytest.raises(ValueError):
        R.check_ref("--output=x")
    assert R.workspace_roots('# roots = ["no"]\nroots = ["a", "../b"]\n') == ["a", "../b"]


def test_tree_is_read_by_its_rules(spark, tmp_path):
    for name, text in {"a.py": "x", "skip.py": "x", "deep/keep.py": "y", "deep/__init__.py": "i", "node_modules/m.js": "z", "empty.py": "", ".gitignore": "skip.py\n/gen/\n", "gen/g.py": "g", "photo.bin": "b"}.items():
        path = Path(tmp_path / "repo" / name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert sorted(r["path"] for r in R.read_tree(spark, str(tmp_path / "repo")).select("path").collect()) == ["a.py", "deep/__init__.py", "deep/keep.py"]


def test_table_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        R.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_streamed_facts(spark, tmp_path):
    from graphlake.streaming import refresh

    schema = "repo_id string, file_id long, lang string, content string, indexed_at timestamp"
    source = str(tmp_path / "in")
    spark.sql("SELECT 'r' repo_id, 1L file_id, 'Python' lang, 'def a(): pass' content, timestamp'2024-01-02' indexed_at").write.parquet(source)
    for text, day in (("def b(): pass", 3), ("def late(): pass", 1)):
        refresh.refresh_facts(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        spark.sql(f"SELECT 'r' repo_id, 1L file_id, 'Python' lang, '{text}' content, timestamp'2024-01-0{day}' indexed_at").write.mode("append").parquet(source)
    refresh.refresh_facts(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = refresh.current_facts(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert [s["name"] for r in got for s in r["symbols"]] == ["b"]


def test_score_and_badge(spark):
    files = spark.createDataFrame([("r", 1, "README.md", None, "Core", 9), ("r", 2, "src/a.py", "Python", "Core", 100), ("r", 3, "tests/t.py", "Python", "Test", 10)], "repo_id string, file_id int, path string, lang string, role string, lines int")
    texts = spark.createDataFrame([(1, "# T\n## A\n## B\n### C\nrun `pytest`\n" + "x" * 400)], "file_id int, content string")
    got = {r["check"]: r["score"] for r in T.score_checks(files, texts, spark.createDataFrame([("r", 0.5)], "repo_id string, share double")).collect()}
    assert got == {"instructions": 0, "commands": 3, "tests": 15, "ci": 0, "modules": 10, "files": 10, "docs": 4, "types": 4}
    once = T.upsert_badge("# T\ntext", "u")
    assert T.upsert_badge(once, "v").count("<!-- score -->") == 1 and "(v)" in T.upsert_badge(once, "v")
    assert T.arguments({"q": "x", "query": "y", "max": 3}) == {"query": "y", "limit": 3}


def test_fixture_trees_are_the_shallowest_without_tests(spark):
    paths = [f"tests/cases/a{i}/x.ts" for i in range(4)] + [f"pkg/testdata/in/{i}.go" for i in range(3)] + [f"tests/unit/{i}.test.ts" for i in range(5)] + ["src/test/java/A.java", "src/test/java/B.java", "src/test/java/C.java", "tests/flat.py", "src/a.py"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    assert {r["dir"]: r["files"] for r in W.fixture_trees(df, 3).collect()} == {"tests/cases": 4, "pkg/testdata": 3}
    assert W.fixture_trees(df.limit(0), 1).count() == 0
