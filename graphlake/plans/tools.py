"""Queries for the tools, extraction, the schema catalogue and several repositories together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.operators import catalog as C
from graphlake.operators import extract as E
from graphlake.operators import graph as G
from graphlake.operators import tools as T
from graphlake.operators import workspace as W
from graphlake.operators.windows import top_per_group
from graphlake.plans import graphs
from graphlake.plans import sql as S
from graphlake.plans.session import kept_index, shared_folder
from graphlake.sources import facts

# A schema of two repositories, in the forms that the catalogue reads: no table holds any.
SOURCES = [
    ("one", "db/001.sql", 'CREATE TABLE IF NOT EXISTS "public"."members" (id uuid PRIMARY KEY, mail varchar(255) NOT NULL UNIQUE, team_id integer REFERENCES teams(id) ON DELETE CASCADE); -- first\n'
     "CREATE TABLE teams (id serial, name text, PRIMARY KEY (id)); CREATE TABLE notes (id bigint NOT NULL, by_id uuid, body text, CONSTRAINT fk FOREIGN KEY (by_id) REFERENCES members (id));"),
    ("one", "db/002.sql", "ALTER TABLE notes ADD COLUMN title text NOT NULL, DROP COLUMN body; ALTER TABLE members RENAME COLUMN mail TO address; CREATE UNIQUE INDEX ix ON notes (by_id, id); CREATE TABLE gone (x int); DROP TABLE gone;"),
    ("one", "db/seeds/003.sql", "CREATE TABLE seeded (x int);"),
    ("two", "prisma/schema.prisma", 'model Person {\n  id Int @id\n  name String?\n  pets Pet[]\n  @@map("people")\n}\nmodel Pet {\n  id Int @id\n  owner_id Int\n  owner Person @relation(fields: [owner_id], references: [id])\n}\n'),
    ("two", "shop/models.py", "from django.db import models\nclass Item(models.Model):\n    name = models.CharField(null=True)\n    buyer = models.ForeignKey('Person', on_delete=models.CASCADE)\n"),
    ("two", "src/schema.rs", "diesel::table! { posts (id) { id -> Int4, person -> Nullable<Int4>, } }\njoinable!(posts -> people (person));"),
]


def _schema(spark: SparkSession) -> DataFrame:
    return C.schema_tables(spark.createDataFrame(SOURCES, "repo_id string, path string, content string"))


def ddl_replay(spark: SparkSession, directory: str) -> DataFrame:
    """Columns of the tables that the sources above leave."""
    tables = _schema(spark).select("repo_id", F.col("name").alias("table"), F.explode("columns").alias("c"))
    return tables.select("repo_id", "table", F.col("c.name").alias("column"), F.col("c.nullable").alias("nullable"), F.col("c.primary").alias("primary_key"))


def fk_edges(spark: SparkSession, directory: str) -> DataFrame:
    return C.foreign_keys(_schema(spark))


def referenced_by(spark: SparkSession, directory: str) -> DataFrame:
    return C.referenced_by(C.foreign_keys(_schema(spark)))


def schema_rank(spark: SparkSession, directory: str) -> DataFrame:
    """PageRank of tables over their foreign keys."""
    shared_folder(spark)
    tables = _schema(spark).select("repo_id", F.col("name").alias("node"))
    keys = C.foreign_keys(_schema(spark)).where("ref_table IS NOT NULL").select("repo_id", F.col("table").alias("src"), F.col("ref_table").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    return G.pagerank(tables, keys, 8, 0.0).select("repo_id", "node", F.round("rank", 6).alias("rank"))


def table_lineage(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of each repository's code that name one of its classes or structs; sixty a name."""
    files = facts.files(spark, directory).where("lang IS NOT NULL").select("repo_id", "file_id")
    names = facts.symbols(spark, directory).where("kind IN ('class', 'struct')").select("repo_id", "name")
    return C.code_references(names, facts.texts(spark, directory).join(files, "file_id").select("repo_id", "file_id", "content"))


def _facts(spark: SparkSession, directory: str) -> DataFrame:
    def build() -> DataFrame:
        return E.file_facts(facts.files(spark, directory), facts.texts(spark, directory)).checkpoint()

    return kept_index(spark, directory, "facts", build)


def extract_symbols(spark: SparkSession, directory: str) -> DataFrame:
    """Definitions read from the texts."""
    rows = _facts(spark, directory).select("repo_id", "file_id", F.explode("symbols").alias("s"))
    return rows.select("repo_id", "file_id", "s.name", "s.kind", "s.start_line", "s.end_line", "s.owner", "s.signature")


def extract_agreement(spark: SparkSession, directory: str) -> DataFrame:
    """Per language: given symbols, those found in the text at the same line by the same name, and found ones in all."""
    found = extract_symbols(spark, directory).select("file_id", "name", "start_line").distinct().withColumn("found", F.lit(1))
    given = facts.symbols(spark, directory).select("file_id", "name", "start_line").distinct().withColumn("given", F.lit(1))
    both = found.join(given, ["file_id", "name", "start_line"], "full").join(facts.files(spark, directory).select("file_id", "lang"), "file_id")
    return both.where("lang IS NOT NULL").groupBy("lang").agg(F.count("given").alias("given"), F.count("found").alias("found"), F.count_if(F.col("given").isNotNull() & F.col("found").isNotNull()).alias("agreed"))


def extract_calls(spark: SparkSession, directory: str) -> DataFrame:
    return _facts(spark, directory).select("file_id", F.explode("calls").alias("c")).select("file_id", "c.*")


def extract_imports(spark: SparkSession, directory: str) -> DataFrame:
    return _facts(spark, directory).select("repo_id", "file_id", F.explode("imports").alias("spec"))


def extract_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return _facts(spark, directory).select("file_id", F.explode("chunks").alias("c")).select("file_id", "c.start_line", "c.end_line", "c.symbol")


def map_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Files, code files, symbols, edges of each repository."""
    i = graphs.index(spark, directory)
    per = lambda df, name: df.groupBy("repo_id").agg(F.count("*").alias(name))
    parts = per(i.files, "files").join(per(i.files.where("lang IS NOT NULL"), "code_files"), "repo_id", "left")
    for df, name in ((i.symbols, "symbols"), (i.edges, "call_edges"), (i.file_edges, "file_edges")):
        parts = parts.join(per(df, name), "repo_id", "left")
    return parts.na.fill(0)


def map_key_files(spark: SparkSession, directory: str) -> DataFrame:
    i = graphs.index(spark, directory)
    return T.key_files(i.files, i.file_rank(), i.file_edges, i.symbols, 5)


def map_key_symbols(spark: SparkSession, directory: str) -> DataFrame:
    i = graphs.index(spark, directory)
    return T.key_symbols(i.files, i.symbols, i.symbol_rank(), i.edges, 5)


def map_modules(spark: SparkSession, directory: str) -> DataFrame:
    i = graphs.index(spark, directory)
    return T.modules(i.files, graphs.communities(spark, directory), i.file_rank())


def context_symbols(spark: SparkSession, directory: str) -> DataFrame:
    """Callers, callees, subtypes and members of each repository's most called symbol."""
    i = graphs.index(spark, directory)
    return T.symbol_context(i.asked(), i.symbols, i.edges, i.files)


def context_files(spark: SparkSession, directory: str) -> DataFrame:
    return T.file_context(graphs.index(spark, directory).files, graphs.index(spark, directory).file_edges, 10)


def trace_paths(spark: SparkSession, directory: str) -> DataFrame:
    """A path between each repository's symbol with most callees and its most called one, by calls, back, or by files."""
    i = graphs.index(spark, directory)
    most = i.edges.groupBy("repo_id", F.col("src").alias("node")).agg(F.count("*").alias("n"))
    start = top_per_group(most, ["repo_id"], [F.desc("n"), F.asc("node")], 1).select("repo_id", F.col("node").alias("query_id"), "node")
    goal = i.asked().join(i.symbols.select(F.col("symbol_id").alias("node"), "repo_id"), "node").select("repo_id", F.col("node").alias("goal"))
    return T.trace(start.join(goal, "repo_id").where("node <> goal").select("query_id", "node", "goal"), i.edges, i.file_edges, i.symbols)


def export_graph(spark: SparkSession, directory: str) -> DataFrame:
    i = graphs.index(spark, directory)
    return T.export_graph(i.files, i.symbols, i.file_rank(), i.symbol_rank(), graphs.communities(spark, directory))


def _cohesion(i: graphs.Linked) -> DataFrame:
    top = i.files.where("role = 'Core' AND lang IS NOT NULL").select("file_id", F.element_at(F.split("path", "/"), 1).alias("m"))
    met = i.file_edges.join(top.select(F.col("file_id").alias("src"), F.col("m").alias("x")), "src").join(top.select(F.col("file_id").alias("dst"), F.col("m").alias("y")), "dst")
    return met.groupBy("repo_id").agg((F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))


def score_checks(spark: SparkSession, directory: str) -> DataFrame:
    """The eight checks of every repository; modules are top-level directories here."""
    i = graphs.index(spark, directory)
    return T.score_checks(i.files, facts.texts(spark, directory), _cohesion(i))


def score_total(spark: SparkSession, directory: str) -> DataFrame:
    return score_checks(spark, directory).groupBy("repo_id").agg(F.sum("score").alias("score"), F.sum("most").alias("most"))


def _packages(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Stand-ins for manifests: directories of Go code as packages, and the Go imports of other repositories as uses."""
    files = facts.files(spark, directory).where("lang = 'Go'")
    last = F.regexp_extract(P.parent_dir(F.col("path")), r"([^/]+)$", 1)
    packages = files.select("repo_id", F.lit("go").alias("kind"), F.concat(F.lit("forge.example/"), last).alias("key"), P.parent_dir(F.col("path")).alias("dir")).where(last != "").distinct()
    imports = facts.imports(spark, directory).join(files.select("repo_id", "file_id", "lang"), ["repo_id", "file_id"])
    return packages, W.consumed(imports)


def package_join(spark: SparkSession, directory: str) -> DataFrame:
    edges = W.cross_edges(*_packages(spark, directory))
    return edges.select("from_repo", "from_file", "package", "to_repo", "dir")


def repository_links(spark: SparkSession, directory: str) -> DataFrame:
    return W.repository_links(W.cross_edges(*_packages(spark, directory)))


def reverse_importers(spark: SparkSession, directory: str) -> DataFrame:
    """Files and the files of other repositories that use their package."""
    files = facts.files(spark, directory).where("lang = 'Go'")
    return W.importers_of(W.cross_edges(*_packages(spark, directory)), files)


def cross_repo_spread(spark: SparkSession, directory: str) -> DataFrame:
    """Repositories that depend on each, within three steps."""
    shared_folder(spark)
    start = facts.files(spark, directory).select(F.col("repo_id").alias("query_id"), "repo_id").distinct()
    return W.spread(W.cross_edges(*_packages(spark, directory)), start)


QUERIES = {f.__name__: f for f in (
    ddl_replay, fk_edges, referenced_by, schema_rank, table_lineage, extract_symbols, extract_agreement, extract_calls, extract_imports, extract_chunks, map_totals, map_key_files, map_key_symbols, map_modules,
    context_symbols, context_files, trace_paths, export_graph, score_checks, score_total, package_join, repository_links, reverse_importers, cross_repo_spread)}

_L, _LR = f"WITH {graphs.LINKED}", f"WITH RECURSIVE {graphs.LINKED}"
_PACKAGES = rf"""{S.FILES}, {S.IMPORTS}, go AS (SELECT *, regexp_extract({S.parent('path')}, '([^/]+)$', 1) AS last FROM files2 WHERE lang = 'Go'),
pk AS (SELECT 'forge.example/' || last AS key, min(struct_pack(r := repo_id, d := {S.parent('path')})) AS o FROM go WHERE last <> '' GROUP BY 1),
us AS (SELECT i.repo_id, i.file_id, array_to_string(string_split(spec, '/')[:k], '/') AS key, array_to_string(string_split(spec, '/')[k + 1:], '/') AS sub FROM imports1 i JOIN go g ON g.repo_id = i.repo_id AND g.file_id = i.file_id, unnest(range(2, len(string_split(spec, '/')) + 1)) AS t(k) WHERE contains(spec, '/') AND contains(spec, '.')),
cross_e AS (SELECT DISTINCT us.repo_id AS from_repo, file_id AS from_file, key AS package, sub, o.r AS to_repo, o.d AS dir FROM us JOIN pk USING (key) WHERE us.repo_id <> o.r)"""
_SCORED = f"""{S.FILES}, {S.TEXTS}, x AS (SELECT f.*, coalesce(content, '') AS content, lower(coalesce(content, '')) AS low FROM files2 f LEFT JOIN texts1 t USING (file_id))"""
ORACLES = {
    "ddl_replay": """SELECT * FROM (VALUES ('one', 'members', 'id', false, true), ('one', 'members', 'address', false, false), ('one', 'members', 'team_id', true, false), ('one', 'teams', 'id', false, true), ('one', 'teams', 'name', true, false),
('one', 'notes', 'id', false, false), ('one', 'notes', 'by_id', true, false), ('one', 'notes', 'title', false, false), ('two', 'people', 'id', false, true), ('two', 'people', 'name', true, false), ('two', 'Pet', 'id', false, true), ('two', 'Pet', 'owner_id', false, false),
('two', 'shop_item', 'id', false, true), ('two', 'shop_item', 'name', true, false), ('two', 'shop_item', 'buyer_id', false, false), ('two', 'posts', 'id', false, true), ('two', 'posts', 'person', true, false)) AS t(repo_id, "table", "column", nullable, primary_key)""",
    "fk_edges": """SELECT * FROM (VALUES ('one', 'members', 'team_id', 'teams'), ('one', 'notes', 'by_id', 'members'), ('two', 'Pet', 'owner_id', 'people'), ('two', 'shop_item', 'buyer_id', 'people'), ('two', 'posts', 'person', 'people')) AS t(repo_id, "table", columns, ref_table)""",
    "referenced_by": "SELECT * FROM (VALUES ('one', 'teams', 'members'), ('one', 'members', 'notes'), ('two', 'people', 'Pet,posts,shop_item')) AS t(repo_id, ref_table, tables)",
    "table_lineage": rf"""WITH {S.FILES}, {S.SYMBOLS}, {S.TEXTS}, n AS (SELECT DISTINCT repo_id, name FROM symbols1 WHERE kind IN ('class', 'struct')), l AS (SELECT repo_id, file_id, i AS line, string_split(content, chr(10))[i] AS text FROM texts1 JOIN files2 USING (file_id), unnest(range(1, len(string_split(content, chr(10))) + 1)) AS t(i) WHERE lang IS NOT NULL),
w AS (SELECT DISTINCT repo_id, file_id, line, unnest(regexp_extract_all(text, '\w+')) AS name FROM l WHERE NOT regexp_matches(text, '^\s*(import|from|use|#include|require|package)\b'))
SELECT repo_id, name, file_id, CAST(line AS INTEGER) AS line FROM w JOIN n USING (repo_id, name) QUALIFY row_number() OVER (PARTITION BY repo_id, name ORDER BY file_id, w.line) <= 60""",
    "map_totals": f"""{_L}, f AS (SELECT repo_id, count(*) AS files, count(*) FILTER (lang IS NOT NULL) AS code_files FROM files2 GROUP BY 1) SELECT f.*, coalesce(s, 0) AS symbols, coalesce(c, 0) AS call_edges, coalesce(e, 0) AS file_edges FROM f LEFT JOIN (SELECT repo_id, count(*) AS s FROM symbols1 GROUP BY 1) USING (repo_id)
LEFT JOIN (SELECT repo_id, count(*) AS c FROM sedges GROUP BY 1) USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS e FROM fedges GROUP BY 1) USING (repo_id)""",
    "map_key_files": f"""{_L}, {graphs.ranks()}, k AS (SELECT f.repo_id, file_id, path, rank FROM files2 f JOIN franks r USING (file_id) WHERE lang IS NOT NULL AND NOT is_test QUALIFY row_number() OVER (PARTITION BY f.repo_id ORDER BY round(rank, 12) DESC, file_id) <= 5)
SELECT repo_id, file_id, path, round(rank, 3) AS rank, (SELECT count(*) FROM symbols1 s WHERE s.file_id = k.file_id) AS symbols, (SELECT count(*) FROM fedges e WHERE e.dst = k.file_id) AS imported_by FROM k""",
    "map_key_symbols": f"""{_L}, {graphs.ranks()} SELECT s.repo_id, symbol_id, name, (SELECT count(*) FROM sedges e WHERE e.dst = s.symbol_id) AS callers FROM symbols1 s JOIN sranks r USING (symbol_id) JOIN files2 f USING (file_id) WHERE lang IS NOT NULL AND NOT is_test
QUALIFY row_number() OVER (PARTITION BY s.repo_id ORDER BY round(rank, 12) DESC, symbol_id) <= 5""",
    "context_symbols": f"""{_L}, {graphs._ASKED}, e AS (SELECT query_id, CASE WHEN kind = 'Extends' THEN 'subtype' ELSE 'caller' END AS relation, src AS symbol_id, line FROM asked JOIN sedges ON dst = query_id UNION ALL SELECT query_id, 'callee', dst, line FROM asked JOIN sedges ON src = query_id
UNION ALL SELECT query_id, 'member', symbol_id, start_line FROM asked JOIN symbols1 ON parent = query_id) SELECT query_id, relation, symbol_id, line FROM e JOIN symbols1 s USING (symbol_id) QUALIFY row_number() OVER (PARTITION BY query_id, relation ORDER BY s.file_id, line, symbol_id) <= 10""",
    "context_files": f"""{_L}, e AS (SELECT src AS file_id, 'imports' AS relation, dst AS other, weight FROM fedges UNION ALL SELECT dst, 'imported_by', src, weight FROM fedges) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY file_id, relation ORDER BY weight DESC, other) <= 10""",
    "package_join": f"WITH {_PACKAGES} SELECT DISTINCT from_repo, from_file, package, to_repo, dir FROM cross_e",
    "repository_links": f"WITH {_PACKAGES} SELECT from_repo, to_repo, count(DISTINCT from_file) AS files FROM cross_e GROUP BY ALL",
    "cross_repo_spread": f"""WITH RECURSIVE {_PACKAGES}, w AS (SELECT DISTINCT repo_id AS query_id, repo_id, 0 AS hop FROM files2 UNION SELECT w.query_id, c.from_repo, w.hop + 1 FROM w JOIN cross_e c ON c.to_repo = w.repo_id WHERE w.hop < 3) SELECT query_id, repo_id, min(hop) AS hop FROM w GROUP BY ALL HAVING min(hop) > 0""",
}
