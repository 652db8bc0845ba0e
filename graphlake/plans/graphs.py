"""Queries over the import, call and file graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.operators import graph as G
from graphlake.operators import resolve as R
from graphlake.operators.windows import top_per_group
from graphlake.plans import sql as S
from graphlake.plans.session import kept_index, shared_folder
from graphlake.sources import facts

# Rounds of PageRank in the queries that SQL checks; the operator itself runs to convergence.
ROUNDS = 8
# Symbols whose impact, traces and trees the queries ask for: each repository's most called ones.
ASKED = 1


class Linked:
    """The resolved graphs of a data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        shared_folder(spark)
        # Written once: every step below reads them again.
        self.files, self.symbols = facts.files(spark, directory).checkpoint(), facts.symbols(spark, directory).checkpoint()
        self.imports = R.resolve_imports(self.files, facts.imports(spark, directory)).checkpoint()
        self.calls = R.resolve_calls(self.files, self.symbols, facts.calls(spark, directory), self.imports).checkpoint()
        self.edges = R.symbol_edges(self.calls).checkpoint()
        self.file_edges = R.file_edges(self.calls, self.imports).checkpoint()
        self._ranks: dict[object, DataFrame] = {}

    def file_nodes(self) -> DataFrame:
        return self.files.select("repo_id", F.col("file_id").alias("node"))

    def file_rank(self, iterations: int = ROUNDS, tolerance: float = 0.0) -> DataFrame:
        key = (iterations, tolerance)
        if key not in self._ranks:
            self._ranks[key] = G.pagerank(self.file_nodes(), self.file_edges.select("repo_id", "src", "dst", "weight"), iterations, tolerance).checkpoint()
        return self._ranks[key]

    def symbol_rank(self) -> DataFrame:
        if "symbols" not in self._ranks:
            self._ranks["symbols"] = G.symbol_rank(self.symbols, self.edges, self.file_rank(), self.files).checkpoint()
        return self._ranks["symbols"]

    def asked(self) -> DataFrame:
        """(query_id, node): the most called symbols of each repository, by callers, then by id."""
        counts = self.edges.groupBy("repo_id", F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        top = top_per_group(counts, ["repo_id"], [F.desc("n"), F.asc("node")], ASKED)
        return top.select(F.col("node").alias("query_id"), "node")


def index(spark: SparkSession, directory: str) -> Linked:
    """The resolved graphs of a data directory, built once in an application."""
    return kept_index(spark, directory, "graphs", lambda: Linked(spark, directory))


def import_edges(spark: SparkSession, directory: str) -> DataFrame:
    return index(spark, directory).imports


def call_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Symbol edges: the name-resolution ladder and its deduplication."""
    return index(spark, directory).edges.select("repo_id", "src", "dst", "kind", "line")


def edge_aggregate(spark: SparkSession, directory: str) -> DataFrame:
    """File edges with their weights, and each file's share of its weight."""
    edges = index(spark, directory).file_edges
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    return edges.join(out, "src").select("repo_id", "src", "dst", "imports", "calls", "weight", F.round(F.col("weight") / F.col("out"), 6).alias("share"))


def undirected_edges(spark: SparkSession, directory: str) -> DataFrame:
    return G.undirected(index(spark, directory).file_edges)


def caller_counts(spark: SparkSession, directory: str) -> DataFrame:
    edges = index(spark, directory).edges
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("callers"), F.count_if(F.col("kind") == "Extends").alias("subtypes"))


def pagerank(spark: SparkSession, directory: str) -> DataFrame:
    """Eight rounds of PageRank over every repository's files."""
    return index(spark, directory).file_rank().select("repo_id", F.col("node").alias("file_id"), F.round("rank", 6).alias("rank"))


def pagerank_converged(spark: SparkSession, directory: str) -> DataFrame:
    return index(spark, directory).file_rank(G.ITERATIONS, G.TOLERANCE).select("repo_id", F.col("node").alias("file_id"), F.round("rank", 4).alias("rank"))


def symbol_rank(spark: SparkSession, directory: str) -> DataFrame:
    linked = index(spark, directory)
    return linked.symbol_rank().select("symbol_id", F.round("rank", 6).alias("rank"))


def khop_impact(spark: SparkSession, directory: str) -> DataFrame:
    """What reaches each asked symbol through calls in at most three steps."""
    linked = index(spark, directory)
    reached = G.breadth_first(G.reverse(linked.edges), linked.asked(), 3)
    return reached.where("depth > 0").select("query_id", "node", "depth")


def impact_sites(spark: SparkSession, directory: str) -> DataFrame:
    """The same with the call that is cited for each."""
    linked = index(spark, directory)
    reached = G.breadth_first(G.reverse(linked.edges), linked.asked(), 3).where("depth > 0")
    lines = linked.edges.select(F.col("src").alias("node"), F.col("dst").alias("parent"), "line")
    return reached.join(lines, ["node", "parent"]).select("query_id", "node", "depth", "parent", "line")


def import_scenario(spark: SparkSession, directory: str) -> DataFrame:
    """Files imported by specs that lead somewhere: every code file imports, as its language writes it, the next one by path."""
    shared_folder(spark)
    files = facts.files(spark, directory)
    following = Window.partitionBy("repo_id", "lang").orderBy("path", "file_id")
    pairs = files.where(F.col("lang").isin("TypeScript", "Tsx", "JavaScript", "Python", "C", "Java", "Go")).withColumn("goal", F.lead("path").over(following)).where("goal IS NOT NULL")
    bare, ups = P.strip_ext(F.col("goal")), F.size(F.split("path", "/")) - 1
    spec = (
        F.when(F.col("lang") == "Go", F.concat(F.lit("forge.example/"), P.parent_dir(F.col("goal")))).when(F.col("lang") == "C", F.col("goal"))
        .when(F.col("lang").isin("Python", "Java"), F.replace(bare, F.lit("/"), F.lit("."))).otherwise(F.concat(F.lit("./"), F.repeat(F.lit("../"), ups), bare)))
    return R.resolve_imports(files, pairs.select("repo_id", "file_id", spec.alias("spec")))


def _changes(spark: SparkSession, directory: str) -> DataFrame:
    """Every fiftieth chunk taken as a change of its lines."""
    chunks = facts.chunks(spark, directory).where("chunk_id % 50 = 0 AND end_line >= start_line")
    return chunks.select(F.col("chunk_id").alias("query_id"), "file_id", F.col("start_line").alias("first"), F.col("end_line").alias("last"))


def impact_changed(spark: SparkSession, directory: str) -> DataFrame:
    """What reaches the symbols of each change through calls in at most three steps."""
    linked = index(spark, directory)
    sources = R.changed_targets(_changes(spark, directory), linked.symbols)
    return G.breadth_first(G.reverse(linked.edges), sources, 3).where("depth > 0").select("query_id", "node", "depth")


def impact_files(spark: SparkSession, directory: str) -> DataFrame:
    """The files that depend, in at most three steps, on every fiftieth file."""
    linked = index(spark, directory)
    start = linked.files.where("lang IS NOT NULL AND file_id % 50 = 0").select(F.col("file_id").alias("query_id"), F.col("file_id").alias("node"))
    back = G.reverse(linked.file_edges).withColumn("ord", F.col("dst"))
    return G.breadth_first(back, start, 3).where("depth > 0").select("query_id", "node", "depth")


def _symbol_ranks(linked: Linked) -> DataFrame:
    return linked.symbol_rank().select("symbol_id", F.round("rank", 6).alias("rank")).join(linked.symbols.select("symbol_id", "repo_id"), "symbol_id")


def hot_symbols(spark: SparkSession, directory: str) -> DataFrame:
    """The fiftieth part of each repository's symbols that ranks highest."""
    return G.hot(_symbol_ranks(index(spark, directory)))


def change_risk(spark: SparkSession, directory: str) -> DataFrame:
    """The risk of each change: direct callers, everything within three steps, directories, files importing it, and whether it is hot."""
    linked = index(spark, directory)
    changes = _changes(spark, directory)
    sources = R.changed_targets(changes, linked.symbols).checkpoint()
    reached = G.breadth_first(G.reverse(linked.edges), sources, 3)
    dirs = linked.files.select("file_id", P.parent_dir(F.col("path")).alias("dir"))
    placed = reached.join(linked.symbols.select(F.col("symbol_id").alias("node"), "file_id"), "node").join(dirs, "file_id")
    sums = placed.groupBy("query_id").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 0).alias("total"), F.countDistinct("dir").alias("modules"))
    importers = linked.file_edges.where("imports > 0").groupBy(F.col("dst").alias("file_id")).agg(F.countDistinct("src").alias("importers"))
    hot = sources.join(G.hot(_symbol_ranks(linked)).select(F.col("symbol_id").alias("node")), "node", "left_semi").select("query_id", F.lit(True).alias("hot")).distinct()
    full = changes.select("query_id", "file_id").join(sums, "query_id").join(importers, "file_id", "left").join(hot, "query_id", "left").fillna({"importers": 0, "hot": False})
    high = (F.col("direct") >= 20) | (F.col("total") >= 60) | (F.col("modules") >= 6) | (F.col("hot") & (F.col("direct") >= 5))
    medium = (F.col("direct") >= 5) | (F.col("total") >= 15) | (F.col("modules") >= 3) | (F.col("importers") >= 10)
    return full.select("query_id", "direct", "total", "modules", "importers", "hot", F.when(high, "high").when(medium, "medium").otherwise("low").alias("risk"))


def shortest_path(spark: SparkSession, directory: str) -> DataFrame:
    """From each repository's symbol with most callees to its most called one: the length of the shortest call path."""
    reached, goals = _routes(spark, directory)
    ends = reached.where("depth > 0").join(goals, ["query_id", "node"], "left_semi")
    return ends.groupBy("query_id").agg(F.min("depth").alias("hops"))


def shortest_path_hops(spark: SparkSession, directory: str) -> DataFrame:
    reached, goals = _routes(spark, directory)
    return G.shortest_paths(reached, goals).select("query_id", "hop", "from_node", "to_node")


def _routes(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    linked = index(spark, directory)
    most = linked.edges.groupBy("repo_id", F.col("src").alias("node")).agg(F.count("*").alias("n"))
    start = top_per_group(most, ["repo_id"], [F.desc("n"), F.asc("node")], 1).select("repo_id", F.col("node").alias("query_id"), "node")
    goal = linked.edges.groupBy("repo_id", F.col("dst").alias("goal")).agg(F.count("*").alias("n"))
    goal = top_per_group(goal, ["repo_id"], [F.desc("n"), F.asc("goal")], 1).select("repo_id", "goal")
    goals = start.join(goal, "repo_id").select("query_id", F.col("goal").alias("node"))
    return G.breadth_first(linked.edges, start.select("query_id", "node"), 6, targets=goals), goals


def file_path(spark: SparkSession, directory: str) -> DataFrame:
    """Steps along file dependencies, at most four, from each repository's first file with any."""
    linked = index(spark, directory)
    start = linked.file_edges.groupBy("repo_id").agg(F.min("src").alias("node")).select(F.col("node").alias("query_id"), "node")
    reached = G.breadth_first(linked.file_edges.withColumn("ord", F.col("dst")), start, 4)
    return reached.where("depth > 0").select("query_id", "node", "depth")


def call_tree(spark: SparkSession, directory: str) -> DataFrame:
    """Callees of each repository's symbol with most of them: at most twelve a node, to depth three."""
    linked = index(spark, directory)
    most = linked.edges.groupBy("repo_id", F.col("src").alias("node")).agg(F.count("*").alias("n"))
    start = top_per_group(most, ["repo_id"], [F.desc("n"), F.asc("node")], 1).select(F.col("node").alias("query_id"), "node")
    tree = G.breadth_first(linked.edges, start, 3, fan_out=12, stop_rows=80)
    return tree.where("depth > 0").select("query_id", "node", "depth", "parent")


def tests_reaching(spark: SparkSession, directory: str) -> DataFrame:
    """Test files that reach each asked symbol in at most three steps, the first twenty by path."""
    linked = index(spark, directory)
    reached = G.breadth_first(G.reverse(linked.edges), linked.asked(), 3).where("depth > 0")
    tests = linked.files.where("is_test").select("file_id", "path")
    hit = reached.join(linked.symbols.select(F.col("symbol_id").alias("node"), "file_id"), "node").join(tests, "file_id").select("query_id", "path").distinct()
    return top_per_group(hit, ["query_id"], [F.asc("path")], 20)


def direct_tests(spark: SparkSession, directory: str) -> DataFrame:
    """Files and the test files that import or call them."""
    linked = index(spark, directory)
    tests = linked.files.where("is_test").select(F.col("file_id").alias("src"), F.col("path").alias("test"))
    return linked.file_edges.join(tests, "src").select(F.col("dst").alias("file_id"), "test").distinct()


def untested_files(spark: SparkSession, directory: str) -> DataFrame:
    """Core code files that no test file depends on."""
    linked = index(spark, directory)
    tests = linked.files.where("is_test").select(F.col("file_id").alias("src"))
    used = linked.file_edges.join(tests, "src", "left_semi").select(F.col("dst").alias("file_id")).distinct()
    return linked.files.where("lang IS NOT NULL AND role = 'Core'").join(used, "file_id", "left_anti").select("file_id", "path")


def risk_level(spark: SparkSession, directory: str) -> DataFrame:
    """Direct callers, everything within three steps, and the risk of changing each asked symbol."""
    linked = index(spark, directory)
    reached = G.breadth_first(G.reverse(linked.edges), linked.asked(), 3).where("depth > 0")
    where = linked.symbols.select(F.col("symbol_id").alias("node"), "file_id").join(linked.files.select("file_id", P.parent_dir(F.col("path")).alias("dir")), "file_id")
    sums = reached.join(where, "node").groupBy("query_id").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total"), F.countDistinct("dir").alias("modules"))
    return sums.withColumn("risk", F.when((F.col("direct") >= 20) | (F.col("total") >= 60) | (F.col("modules") >= 6), "high").when(
        (F.col("direct") >= 5) | (F.col("total") >= 15) | (F.col("modules") >= 3), "medium").otherwise("low"))


def communities(spark: SparkSession, directory: str) -> DataFrame:
    """Modules of core code files: Louvain, with small ones folded into their surroundings."""
    linked = index(spark, directory)
    core = linked.files.where("lang IS NOT NULL AND role = 'Core'")
    inside = linked.file_edges.join(core.select(F.col("file_id").alias("src")), "src", "left_semi").join(core.select(F.col("file_id").alias("dst")), "dst", "left_semi")
    label = G.communities(core.select("repo_id", F.col("file_id").cast("long").alias("node")), inside).checkpoint()
    return G.fold_small(label, core, inside).select("repo_id", F.col("node").alias("file_id"), "community")


def modularity(spark: SparkSession, directory: str) -> DataFrame:
    """How well the communities of each repository separate its files."""
    linked = index(spark, directory)
    label = G.communities(linked.file_nodes().withColumn("node", F.col("node").cast("long")), linked.file_edges)
    return G.modularity(linked.file_edges, label).select("repo_id", F.round("modularity", 6).alias("modularity"))


def dir_vote(spark: SparkSession, directory: str) -> DataFrame:
    """The language that most files of a directory are in; ties go to the first by name."""
    files = facts.files(spark, directory).where("lang IS NOT NULL").groupBy("repo_id", P.parent_dir(F.col("path")).alias("dir"), "lang").agg(F.count("*").alias("n"))
    return top_per_group(files, ["repo_id", "dir"], [F.desc("n"), F.asc("lang")], 1).select("repo_id", "dir", "lang", "n")


def dir_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of code under every directory prefix, and their share of the repository's."""
    files = facts.files(spark, directory).where("lang IS NOT NULL")
    total = files.groupBy("repo_id").agg(F.sum("lines").alias("total"))
    each = files.select("repo_id", "lines", F.explode(P.dir_prefixes(P.parent_dir(F.col("path")))).alias("dir")).groupBy("repo_id", "dir").agg(F.sum("lines").alias("lines"))
    return each.join(total, "repo_id").select("repo_id", "dir", "lines", F.round(F.col("lines") / F.col("total"), 6).alias("share"))


def module_dependencies(spark: SparkSession, directory: str) -> DataFrame:
    """The four top-level directories that each depends on most."""
    linked = index(spark, directory)
    top = linked.files.select("file_id", F.element_at(F.split("path", "/"), 1).alias("m"))
    met = linked.file_edges.join(top.select(F.col("file_id").alias("src"), F.col("m").alias("module")), "src").join(top.select(F.col("file_id").alias("dst"), F.col("m").alias("needs")), "dst")
    sums = met.where(F.col("module") != F.col("needs")).groupBy("repo_id", "module", "needs").agg(F.sum("weight").alias("weight"))
    return top_per_group(sums, ["repo_id", "module"], [F.desc("weight"), F.asc("needs")], 4)


def cohesion_share(spark: SparkSession, directory: str) -> DataFrame:
    """The share of dependencies that stay inside a top-level directory, and the pair with most that cross."""
    linked = index(spark, directory)
    top = linked.files.select("file_id", F.element_at(F.split("path", "/"), 1).alias("m"))
    met = linked.file_edges.join(top.select(F.col("file_id").alias("src"), F.col("m").alias("x")), "src").join(top.select(F.col("file_id").alias("dst"), F.col("m").alias("y")), "dst")
    pairs = met.groupBy("repo_id", "x", "y").agg(F.sum("weight").alias("w"))
    inside = F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0))
    cross = F.max(F.when(F.col("x") != F.col("y"), F.struct("w", "x", "y")))
    return pairs.groupBy("repo_id").agg(F.round(inside / F.sum("w"), 6).alias("share"), cross.alias("c")).select("repo_id", "share", F.concat_ws(" -> ", "c.x", "c.y").alias("heaviest"))


def innermost_interval(spark: SparkSession, directory: str) -> DataFrame:
    """The innermost symbol around every call."""
    points = facts.calls(spark, directory).select("file_id", "line").distinct()
    return R.innermost(points, facts.symbols(spark, directory))


def interval_overlap(spark: SparkSession, directory: str) -> DataFrame:
    """Symbols that the chunks of their files touch, chunks taken as changed lines."""
    hunks = facts.chunks(spark, directory).where("end_line >= start_line").select("file_id", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    return R.overlapping(hunks, facts.symbols(spark, directory))


def target_resolve(spark: SparkSession, directory: str) -> DataFrame:
    """Names, upper-case names, owner-qualified names and file positions, each resolved."""
    files, symbols = facts.files(spark, directory), facts.symbols(spark, directory)
    qualified = symbols.where("owner IS NOT NULL").groupBy("repo_id").agg(F.min(F.concat_ws(".", "owner", "name")).alias("query")).select("query")
    names = symbols.groupBy("repo_id").agg(F.max("name").alias("query")).select("query")
    upper = symbols.groupBy("repo_id").agg(F.upper(F.min("name")).alias("query")).select("query")
    places = files.groupBy("repo_id").agg(F.concat(F.min("path"), F.lit(":9")).alias("query")).select("query")
    queries = qualified.unionByName(names).unionByName(upper).unionByName(places).distinct()
    ranks = symbols.select("symbol_id", F.lit(0.0).alias("rank"))
    return R.resolve_targets(queries, files, symbols, ranks).select("query", "at", "file_id", "symbol_id")


QUERIES = {f.__name__: f for f in (
    import_edges, import_scenario, impact_changed, impact_files, hot_symbols, change_risk, call_edges, edge_aggregate, undirected_edges, caller_counts, pagerank, pagerank_converged, symbol_rank, khop_impact, impact_sites, shortest_path, shortest_path_hops,
    file_path, call_tree, tests_reaching, direct_tests, untested_files, risk_level, communities, modularity, dir_vote, dir_coverage, module_dependencies, cohesion_share,
    innermost_interval, interval_overlap, target_resolve)}

_TRY_JS = "list_concat([b || e FOR e IN ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.d.ts']], CASE WHEN ends_with(b, '.js') THEN [left(b, -3) || '.ts', left(b, -3) || '.tsx'] ELSE [] END, CASE WHEN ends_with(b, '.jsx') THEN [left(b, -4) || '.tsx'] ELSE [] END, CASE WHEN ends_with(b, '.mjs') THEN [left(b, -4) || '.mts'] ELSE [] END, [CASE WHEN b = '' THEN i ELSE b || '/' || i END FOR i IN ['index.ts', 'index.tsx', 'index.js', 'index.jsx', 'index.mjs']])"
# An independent reading of the import rules, for the languages and forms of the data.
_IMPORTS = rf"""code AS (SELECT * FROM files2 WHERE lang IS NOT NULL),
wanted AS (SELECT c.repo_id, c.file_id AS src, path, lang, spec, {S.parent('path')} AS dir FROM imports1 i JOIN code c ON c.repo_id = i.repo_id AND c.file_id = i.file_id),
ups AS (SELECT *, [array_to_string(list_filter(string_split(dir, '/'), lambda s: s <> '')[:k], '/') FOR k IN range(len(list_filter(string_split(dir, '/'), lambda s: s <> '')), -1, -1)] AS up FROM wanted),
js AS (SELECT repo_id, src, spec, {S.normalize("dir || '/' || spec")} AS b FROM wanted WHERE lang IN ('TypeScript', 'Tsx', 'JavaScript') AND starts_with(spec, '.')),
tried AS (SELECT repo_id, src, spec, k AS pos, ({_TRY_JS})[k] AS candidate FROM js, unnest(range(1, len({_TRY_JS}) + 1)) AS t(k)
  UNION ALL SELECT repo_id, src, spec, r * 3 + k, {S.normalize("roots[r] || '/' || replace(spec, '.', '/')")} || ['.py', '/__init__.py', '.pyi'][k] FROM (SELECT *, list_concat(['', 'src'], list_filter(up, lambda d: d <> '')) AS roots FROM ups
    WHERE lang = 'Python' AND NOT starts_with(spec, '.')), unnest(range(1, len(roots) + 1)) AS t(r), unnest([1, 2, 3]) AS u(k)
  UNION ALL SELECT repo_id, src, spec, k, [{S.normalize("dir || '/' || spec")}, {S.normalize('spec')}][k] FROM wanted, unnest([1, 2]) AS u(k) WHERE lang IN ('C', 'Cpp')),
direct AS (SELECT t.repo_id, t.src, t.spec, arg_min(c.file_id, t.pos) AS dst FROM tried t JOIN code c ON c.repo_id = t.repo_id AND c.path = t.candidate GROUP BY ALL),
rest AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.repo_id = w.repo_id AND d.src = w.src AND d.spec = w.spec)),
prefixes AS (SELECT r.*, c.file_id AS dst, c.path AS dst_path, {S.strip('c.path')} AS stem FROM rest r JOIN code c ON c.repo_id = r.repo_id WHERE r.lang IN ('C', 'Cpp', 'Python', 'Java')),
near AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(pa), len(pb)) + 1), lambda i: pa[i] <> pb[i])) - 1, least(len(pa), len(pb))) AS n FROM (
  SELECT *, string_split(CASE WHEN lang = 'Python' THEN path ELSE dir END, '/') AS pa, string_split(dst_path, '/') AS pb FROM prefixes
  WHERE (lang IN ('C', 'Cpp') AND (dst_path = {S.normalize('spec')} OR ends_with(dst_path, '/' || {S.normalize('spec')})))
     OR (lang = 'Python' AND contains(spec, '.') AND NOT starts_with(spec, '.') AND (stem = replace(spec, '.', '/') OR ends_with(stem, '/' || replace(spec, '.', '/')))))),
closest AS (SELECT repo_id, src, spec, arg_max(dst, (n, dst)) AS dst FROM near GROUP BY ALL),
jruns AS (SELECT p.*, pos, array_to_string(string_split(spec, '.')[pos:], '/') AS rel FROM prefixes p, unnest(range(1, len(string_split(spec, '.')))) AS t(pos) WHERE lang = 'Java'),
jhit AS (SELECT *, pos * 2 + CASE WHEN stem = rel THEN 0 ELSE 1 END AS rank FROM jruns WHERE stem = rel OR ends_with(stem, '/' || rel)),
jbest AS (SELECT *, row_number() OVER (PARTITION BY repo_id, src, spec ORDER BY dst) AS rn FROM (SELECT *, min(rank) OVER (PARTITION BY repo_id, src, spec) AS best FROM jhit) WHERE rank = best),
gdirs AS (SELECT DISTINCT repo_id, {S.parent('path')} AS gdir FROM code),
gruns AS (SELECT r.*, pos, array_to_string(string_split(spec, '/')[pos:], '/') AS suffix FROM rest r, unnest(range(1, len(string_split(spec, '/')))) AS t(pos) WHERE lang = 'Go' AND contains(spec, '/')),
ghit AS (SELECT g.repo_id, g.src, g.spec, arg_min(d.gdir, (g.pos, length(d.gdir), d.gdir)) AS gdir FROM gruns g JOIN gdirs d ON d.repo_id = g.repo_id AND (d.gdir = g.suffix OR ends_with(d.gdir, '/' || g.suffix)) GROUP BY ALL),
gfiles AS (SELECT g.repo_id, g.src, g.spec, c.file_id AS dst, row_number() OVER (PARTITION BY g.repo_id, g.src, g.spec ORDER BY c.file_id) AS rn FROM ghit g JOIN code c ON c.repo_id = g.repo_id AND {S.parent('c.path')} = g.gdir WHERE c.lang = 'Go' AND NOT c.is_test),
imp AS (SELECT DISTINCT repo_id, src, dst FROM (SELECT repo_id, src, dst FROM direct UNION ALL SELECT repo_id, src, dst FROM closest UNION ALL SELECT repo_id, src, dst FROM jbest WHERE stem = rel OR rn = 1
  UNION ALL SELECT repo_id, src, dst FROM gfiles WHERE rn <= 24) WHERE src <> dst)"""
_LADDER = f"""degree AS (SELECT repo_id, name, count(*) AS c FROM symbols1 GROUP BY ALL),
met AS (SELECT c.*, s.symbol_id AS target, s.file_id AS target_file, s.owner AS target_owner, f.lang, {S.parent('f.path')} AS dir, {S.parent('g.path')} AS target_dir, k.owner AS caller_owner,
  i.src IS NOT NULL AS imported, c.file_id = s.file_id AS local
  FROM calls1 c JOIN degree d ON d.repo_id = c.repo_id AND d.name = c.name AND d.c <= 400 JOIN symbols1 s ON s.repo_id = c.repo_id AND s.name = c.name
  JOIN files2 f ON f.file_id = c.file_id JOIN files2 g ON g.file_id = s.file_id LEFT JOIN symbols1 k ON k.symbol_id = c.from_symbol LEFT JOIN imp i ON i.repo_id = c.repo_id AND i.src = c.file_id AND i.dst = s.file_id
  WHERE s.symbol_id IS DISTINCT FROM c.from_symbol AND CASE WHEN c.heritage THEN s.kind IN ('class', 'struct', 'interface', 'trait', 'enum', 'module') ELSE s.kind IN ('function', 'method', 'macro', 'class', 'struct') END),
counted AS (SELECT *, coalesce(qual, '') IN ('this', 'self', 'Self', 'cls', 'super', 'me') AS selfish, coalesce(qual, '') <> '' AND coalesce(target_owner = qual, false) AS by_owner, count(*) OVER w AS n_all,
  count(*) FILTER (imported) OVER w AS n_imp, count(*) FILTER (dir = target_dir) OVER w AS n_dir FROM met WINDOW w AS (PARTITION BY call_id)),
ruled AS (SELECT *, CASE WHEN is_member THEN CASE WHEN selfish THEN CASE WHEN local AND target_owner IS NOT DISTINCT FROM caller_owner THEN 1 WHEN local THEN 2 END WHEN by_owner AND (local OR imported) THEN 3 WHEN by_owner THEN 4 WHEN local THEN 5
  WHEN imported AND n_imp <= 3 THEN 6 WHEN n_all = 1 AND length(name) >= 4 AND name NOT IN {S.strings(R.GENERIC_METHODS)} THEN 7 END
  ELSE CASE WHEN local THEN 1 WHEN imported THEN 2 WHEN n_all = 1 THEN 3 WHEN dir = target_dir AND (n_dir = 1 OR (lang IN {S.strings(R.SAME_PACKAGE)} AND n_dir <= 3)) THEN 4 END END AS rule FROM counted),
chosen AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY target) AS pos FROM (SELECT *, min(rule) OVER (PARTITION BY call_id) AS best FROM ruled) WHERE rule = best),
kept AS (SELECT *, call_id * 4 + pos AS ord FROM chosen WHERE pos <= 3),
sedges AS (SELECT repo_id, from_symbol AS src, target AS dst, arg_min(CASE WHEN heritage THEN 'Extends' ELSE 'Calls' END, ord) AS kind, arg_min(line, ord) AS line, min(ord) AS ord FROM kept WHERE from_symbol IS NOT NULL GROUP BY repo_id, from_symbol, target),
fedges AS (SELECT repo_id, src, dst, max(i) AS imports, sum(c)::BIGINT AS calls, (max(i) + sum(c) * 0.5)::DOUBLE AS weight FROM (SELECT repo_id, file_id AS src, target_file AS dst, 0 AS i, 1 AS c FROM kept WHERE file_id <> target_file
  UNION ALL SELECT repo_id, src, dst, 1, 0 FROM imp) GROUP BY repo_id, src, dst)"""
LINKED = f"{S.FILES}, {S.SYMBOLS}, {S.CALLS}, {S.IMPORTS}, {_IMPORTS}, {_LADDER}"
_ASKED = "asked AS (SELECT dst AS query_id FROM (SELECT repo_id, dst, count(*) AS n FROM sedges GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, dst) = 1)"
_REACH = f"""{_ASKED}, walk AS (SELECT query_id, query_id AS node, 0 AS depth FROM asked UNION SELECT w.query_id, e.src, w.depth + 1 FROM walk w JOIN sedges e ON e.dst = w.node WHERE w.depth < 3),
reach AS (SELECT query_id, node, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)"""


def ranks(rounds: int = ROUNDS) -> str:
    parts = [
        "osum AS (SELECT src, sum(weight) AS out FROM fedges GROUP BY src)",
        "share AS MATERIALIZED (SELECT e.src, e.dst, e.weight / o.out AS share FROM fedges e JOIN osum o USING (src))",
        "base AS MATERIALIZED (SELECT f.repo_id, f.file_id AS node, count(*) OVER (PARTITION BY f.repo_id) AS n, o.src IS NULL AS dangling FROM files2 f LEFT JOIN osum o ON o.src = f.file_id)",
        "r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE / n AS rank FROM base)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT b.*, 0.85::DOUBLE * coalesce(g.got, 0) + (1 - 0.85::DOUBLE) / b.n + 0.85::DOUBLE * coalesce(l.lost, 0) / b.n AS rank FROM base b LEFT JOIN (SELECT s.dst, sum(r.rank * s.share) AS got FROM {p} r JOIN share s ON s.src = r.node GROUP BY s.dst) g ON g.dst = b.node "
            f"LEFT JOIN (SELECT repo_id, sum(rank) AS lost FROM {p} WHERE dangling GROUP BY repo_id) l ON l.repo_id = b.repo_id)")
    parts.append(f"franks AS MATERIALIZED (SELECT repo_id, node AS file_id, n, rank / greatest(max(rank) OVER (PARTITION BY repo_id), 1e-12) AS rank FROM r{rounds})")
    parts.append("""sranks AS MATERIALIZED (SELECT s.symbol_id, coalesce(g.got, 0) + f.rank * 0.05 AS rank FROM symbols1 s JOIN franks f USING (file_id) LEFT JOIN (SELECT e.dst, sum(CASE WHEN a.file_id = b.file_id THEN 0.2 ELSE 1 END * (f.rank + 1.0 / f.n)) AS got
FROM sedges e JOIN symbols1 a ON a.symbol_id = e.src JOIN symbols1 b ON b.symbol_id = e.dst JOIN franks f ON f.file_id = a.file_id JOIN franks fb ON fb.file_id = b.file_id GROUP BY e.dst) g ON g.dst = s.symbol_id)""")
    return ", ".join(parts)


_SCENARIO = f"""imports1 AS (SELECT repo_id, file_id, CASE WHEN lang = 'Go' THEN 'forge.example/' || {S.parent('goal')} WHEN lang = 'C' THEN goal WHEN lang IN ('Python', 'Java') THEN replace({S.strip('goal')}, '/', '.')
  ELSE './' || repeat('../', len(string_split(path, '/')) - 1) || {S.strip('goal')} END AS spec FROM (SELECT *, lead(path) OVER (PARTITION BY repo_id, lang ORDER BY path, file_id) AS goal FROM files2
  WHERE lang IN ('TypeScript', 'Tsx', 'JavaScript', 'Python', 'C', 'Java', 'Go')) WHERE goal IS NOT NULL)"""
_CHANGED = f"""{S.CHUNKS}, hunks AS (SELECT chunk_id AS query_id, file_id, start_line AS first, end_line AS last FROM chunks1 WHERE chunk_id % 50 = 0 AND end_line >= start_line),
touched AS (SELECT h.query_id, h.file_id, s.symbol_id FROM hunks h LEFT JOIN symbols1 s ON s.file_id = h.file_id AND h.first <= s.end_line AND h.last >= s.start_line AND s.end_line >= s.start_line AND s.kind NOT IN ('class', 'struct', 'interface', 'trait', 'enum', 'module')),
sources AS (SELECT query_id, symbol_id AS node FROM touched WHERE symbol_id IS NOT NULL UNION SELECT t.query_id, s.symbol_id FROM touched t JOIN symbols1 s ON s.file_id = t.file_id WHERE t.symbol_id IS NULL),
walk AS (SELECT query_id, node, 0 AS depth FROM sources UNION SELECT w.query_id, e.src, w.depth + 1 FROM walk w JOIN sedges e ON e.dst = w.node WHERE w.depth < 3),
hit AS (SELECT query_id, node, min(depth) AS depth FROM walk GROUP BY ALL)"""
_HOT = """hots AS (SELECT repo_id, symbol_id, rank FROM (SELECT *, list_sort(list(rank) OVER (PARTITION BY repo_id), 'DESC')[(count(*) OVER (PARTITION BY repo_id)) // 50 + 1] AS cut FROM (SELECT s.repo_id, r.symbol_id, round(r.rank, 6) AS rank FROM sranks r JOIN symbols1 s USING (symbol_id))) WHERE rank >= cut AND rank > 0)"""
_L = f"WITH {LINKED}"
_LR = f"WITH RECURSIVE {LINKED}"
_TOP = "tops AS (SELECT file_id, string_split(path, '/')[1] AS m FROM files2), cross_w AS (SELECT e.repo_id, a.m AS x, b.m AS y, sum(weight) AS w FROM fedges e JOIN tops a ON a.file_id = e.src JOIN tops b ON b.file_id = e.dst GROUP BY ALL)"
ORACLES = {
    "import_edges": f"{_L} SELECT repo_id, src, dst FROM imp",
    "import_scenario": f"WITH {S.FILES}, {_SCENARIO}, {_IMPORTS} SELECT repo_id, src, dst FROM imp",
    "impact_changed": f"{_LR}, {_CHANGED} SELECT query_id, CAST(node AS BIGINT) AS node, depth FROM hit WHERE depth > 0",
    "impact_files": f"""{_LR}, walk AS (SELECT file_id AS query_id, file_id AS node, 0 AS depth FROM files2 WHERE lang IS NOT NULL AND file_id % 50 = 0 UNION SELECT w.query_id, e.src, w.depth + 1 FROM walk w JOIN fedges e ON e.dst = w.node WHERE w.depth < 3)
SELECT query_id, CAST(node AS BIGINT) AS node, min(depth) AS depth FROM walk GROUP BY query_id, node HAVING min(depth) > 0""",
    "hot_symbols": f"{_L}, {ranks()}, {_HOT} SELECT repo_id, symbol_id, rank FROM hots",
    "change_risk": f"""{_LR}, {ranks()}, {_HOT}, {_CHANGED}, sums AS (SELECT query_id, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 0) AS total, count(DISTINCT {S.parent('path')}) AS modules FROM hit r JOIN symbols1 s ON s.symbol_id = r.node JOIN files2 f USING (file_id) GROUP BY query_id),
users AS (SELECT dst AS file_id, count(DISTINCT src) AS importers FROM fedges WHERE imports > 0 GROUP BY dst), full_ AS (SELECT s.*, coalesce(u.importers, 0) AS importers, EXISTS (SELECT 1 FROM sources x JOIN hots h ON h.symbol_id = x.node WHERE x.query_id = s.query_id) AS hot
  FROM sums s JOIN hunks k USING (query_id) LEFT JOIN users u ON u.file_id = k.file_id)
SELECT query_id, direct, total, modules, importers, hot, CASE WHEN direct >= 20 OR total >= 60 OR modules >= 6 OR (hot AND direct >= 5) THEN 'high' WHEN direct >= 5 OR total >= 15 OR modules >= 3 OR importers >= 10 THEN 'medium' ELSE 'low' END AS risk FROM full_""",
    "call_edges": f"{_L} SELECT repo_id, src, dst, kind, line FROM sedges",
    "edge_aggregate": f"{_L} SELECT repo_id, src, dst, imports, calls, weight, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS share FROM fedges",
    "undirected_edges": f"{_L} SELECT repo_id, least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM fedges GROUP BY ALL",
    "caller_counts": f"{_L} SELECT dst, count(DISTINCT src) AS callers, count(*) FILTER (kind = 'Extends') AS subtypes FROM sedges GROUP BY dst",
    "pagerank": f"{_L}, {ranks()} SELECT repo_id, file_id, round(rank, 6) AS rank FROM franks",
    "symbol_rank": f"{_L}, {ranks()} SELECT symbol_id, round(rank, 6) AS rank FROM sranks",
    "khop_impact": f"{_LR}, {_REACH} SELECT CAST(query_id AS INTEGER) query_id, CAST(node AS BIGINT) node, depth FROM reach",
    "tests_reaching": f"""{_LR}, {_REACH} SELECT query_id, path FROM (SELECT DISTINCT query_id, path FROM reach r JOIN symbols1 s ON s.symbol_id = r.node JOIN files2 f USING (file_id) WHERE is_test)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY path) <= 20""",
    "risk_level": f"""{_LR}, {_REACH}, sums AS (SELECT query_id, count(*) FILTER (depth = 1) AS direct, count(*) AS total, count(DISTINCT {S.parent('path')}) AS modules FROM reach r JOIN symbols1 s ON s.symbol_id = r.node JOIN files2 f USING (file_id) GROUP BY query_id)
SELECT *, CASE WHEN direct >= 20 OR total >= 60 OR modules >= 6 THEN 'high' WHEN direct >= 5 OR total >= 15 OR modules >= 3 THEN 'medium' ELSE 'low' END AS risk FROM sums""",
    "shortest_path": f"""{_LR}, {_ASKED}, starts AS (SELECT repo_id, src FROM (SELECT repo_id, src, count(*) AS n FROM sedges GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, src) = 1),
goals AS (SELECT s.src, a.query_id AS goal FROM starts s JOIN symbols1 y ON y.repo_id = s.repo_id JOIN asked a ON a.query_id = y.symbol_id),
walk AS (SELECT src AS query_id, src AS node, 0 AS depth FROM starts UNION SELECT w.query_id, e.dst, w.depth + 1 FROM walk w JOIN sedges e ON e.src = w.node WHERE w.depth < 6)
SELECT query_id, min(depth) AS hops FROM walk w JOIN goals g ON g.src = w.query_id AND g.goal = w.node WHERE depth > 0 AND node <> query_id GROUP BY query_id""",
    "file_path": f"""{_LR}, starts AS (SELECT min(src) AS query_id FROM fedges GROUP BY repo_id), walk AS (SELECT query_id, query_id AS node, 0 AS depth FROM starts UNION SELECT w.query_id, e.dst, w.depth + 1 FROM walk w JOIN fedges e ON e.src = w.node WHERE w.depth < 4)
SELECT query_id, CAST(node AS BIGINT) AS node, min(depth) AS depth FROM walk GROUP BY query_id, node HAVING min(depth) > 0""",
    "direct_tests": f"{_L} SELECT DISTINCT e.dst AS file_id, f.path AS test FROM fedges e JOIN files2 f ON f.file_id = e.src WHERE f.is_test",
    "untested_files": f"{_L} SELECT file_id, path FROM files2 WHERE lang IS NOT NULL AND role = 'Core' AND file_id NOT IN (SELECT e.dst FROM fedges e JOIN files2 f ON f.file_id = e.src WHERE f.is_test)",
    "dir_vote": f"WITH {S.FILES} SELECT repo_id, dir, lang, n FROM (SELECT repo_id, {S.parent('path')} AS dir, lang, count(*) AS n FROM files2 WHERE lang IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo_id, dir ORDER BY n DESC, lang) = 1",
    "dir_coverage": f"""WITH {S.FILES}, c AS (SELECT repo_id, lines, list_filter(string_split({S.parent('path')}, '/'), lambda s: s <> '') AS ps FROM files2 WHERE lang IS NOT NULL), t AS (SELECT repo_id, sum(lines) AS total FROM c GROUP BY repo_id),
e AS (SELECT repo_id, lines, array_to_string(ps[:k], '/') AS dir FROM c, unnest(range(1, len(ps) + 1)) AS u(k)) SELECT repo_id, dir, CAST(sum(lines) AS BIGINT) AS lines, round(sum(lines) / any_value(total), 6) AS share FROM e JOIN t USING (repo_id) GROUP BY repo_id, dir""",
    "module_dependencies": f"{_L}, {_TOP} SELECT repo_id, x AS module, y AS needs, w AS weight FROM cross_w WHERE x <> y QUALIFY row_number() OVER (PARTITION BY repo_id, x ORDER BY w DESC, y) <= 4",
    "cohesion_share": f"""{_L}, {_TOP} SELECT repo_id, round(coalesce(sum(w) FILTER (x = y), 0) / sum(w), 6) AS share, coalesce(max(struct_pack(w := w, x := x, y := y)) FILTER (x <> y).x || ' -> ' || max(struct_pack(w := w, x := x, y := y)) FILTER (x <> y).y, '') AS heaviest FROM cross_w GROUP BY repo_id""",
    "innermost_interval": f"""WITH {S.SYMBOLS}, {S.CALLS}, p AS (SELECT DISTINCT file_id, line FROM calls1), h AS (SELECT p.file_id, p.line, arg_min(symbol_id, (end_line - start_line, symbol_id)) AS symbol_id FROM p JOIN symbols1 s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line GROUP BY ALL)
SELECT p.file_id, p.line, h.symbol_id FROM p LEFT JOIN h ON h.file_id IS NOT DISTINCT FROM p.file_id AND h.line = p.line""",
    "interval_overlap": f"""WITH {S.SYMBOLS}, {S.CHUNKS}, h AS (SELECT DISTINCT file_id, start_line AS first, end_line AS last FROM chunks1 WHERE end_line >= start_line)
SELECT DISTINCT h.file_id, h.first, h.last, s.symbol_id FROM h LEFT JOIN symbols1 s ON s.file_id = h.file_id AND h.first <= s.end_line AND h.last >= s.start_line AND s.end_line >= s.start_line AND s.kind NOT IN ('class', 'struct', 'interface', 'trait', 'enum', 'module')""",
}
