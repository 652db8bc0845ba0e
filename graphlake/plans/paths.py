"""Queries over paths, names and texts: the scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.functions import text as X
from graphlake.operators import windows as W
from graphlake.plans import sql as S
from graphlake.sources import facts
from graphlake.sources.tables import one_each, table

QUESTION = "how are routes registered in the session router of the cursor"
MENTIONS = ("session.py", "bridge/buffer/vault", "router.ts", "src/gauge/loader.js")


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return one_each(table(spark, directory, "documents"), "doc_id")


def path_parts(spark: SparkSession, directory: str) -> DataFrame:
    p = F.col("path")
    return facts.files(spark, directory).select("file_id", P.parent_dir(p).alias("dir"), P.file_name(p).alias("name"), P.extension(p).alias("ext"), P.strip_ext(p).alias("stem"))


def path_normalize(spark: SparkSession, directory: str) -> DataFrame:
    relative = F.concat(P.parent_dir(F.col("path")), F.lit("/../x//./"), P.file_name(F.col("path")))
    return facts.files(spark, directory).select("file_id", P.normalize(relative).alias("path"))


def dir_suffixes(spark: SparkSession, directory: str) -> DataFrame:
    return facts.files(spark, directory).select("repo_id", P.parent_dir(F.col("path")).alias("dir")).distinct().select("repo_id", "dir", F.explode(P.dir_suffixes(F.col("dir"))).alias("suffix"))


def common_prefix(spark: SparkSession, directory: str) -> DataFrame:
    """Each file against the first of its repository."""
    files = facts.files(spark, directory)
    first = files.groupBy("repo_id").agg(F.min("path").alias("first"))
    return files.join(first, "repo_id").select("file_id", P.common_prefix(F.col("path"), F.col("first")).alias("shared"))


def pretty_dir(spark: SparkSession, directory: str) -> DataFrame:
    return facts.files(spark, directory).select("file_id", P.pretty_dir(P.parent_dir(F.col("path"))).alias("dir"))


def file_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """Language, searchability, ignore rules, test flag and role of every file."""
    p = F.col("path")
    return facts.files(spark, directory).select("file_id", "lang", P.searchable_text(p).alias("searchable"), P.ignored(p).alias("ignored"), "is_test", "role")


def include_override(spark: SparkSession, directory: str) -> DataFrame:
    files = facts.files(spark, directory)
    return files.where(P.under(F.col("path"), F.lit("src")) | P.under(F.col("path"), F.lit("docs"))).select("file_id", "path")


def path_match_share(spark: SparkSession, directory: str) -> DataFrame:
    return facts.files(spark, directory).select("file_id", F.round(P.path_match(F.col("path"), X.query_words(F.lit(QUESTION))), 6).alias("share")).where("share > 0")


def path_penalty(spark: SparkSession, directory: str) -> DataFrame:
    return facts.files(spark, directory).select("file_id", F.round(P.path_penalty(F.col("path"), F.col("role"), F.col("lang")), 6).alias("penalty"))


def path_mention(spark: SparkSession, directory: str) -> DataFrame:
    """The strongest of some mentions for each file."""
    best = F.greatest(*[P.path_mention(F.col("path"), F.lit(m)) for m in MENTIONS])
    return facts.files(spark, directory).select("file_id", best.alias("mention")).where("mention > 0")


def camel_tokens(spark: SparkSession, directory: str) -> DataFrame:
    return facts.symbols(spark, directory).select("symbol_id", F.array_join(X.tokens(F.col("name")), " ").alias("words"), X.snake_case(F.col("name")).alias("snake"))


def query_words(spark: SparkSession, directory: str) -> DataFrame:
    items = one_each(table(spark, directory, "eval_items"), "item_id")
    return items.select("item_id", F.array_join(X.query_words(F.col("text")), " ").alias("words"))


def looks_like_symbol(spark: SparkSession, directory: str) -> DataFrame:
    return facts.symbols(spark, directory).select("name").distinct().where(X.looks_like_symbol(F.col("name")))


def query_analysis(spark: SparkSession, directory: str) -> DataFrame:
    """Title and identifiers of every document, read as a query."""
    return _documents(spark, directory).select("doc_id", X.query_head(F.col("text")).alias("head"), F.array_join(X.code_words(F.col("text")), " ").alias("idents"))


def token_estimate(spark: SparkSession, directory: str) -> DataFrame:
    return _documents(spark, directory).select("doc_id", X.estimate_tokens(F.col("text")).alias("n_tokens"), X.truncate(F.col("text"), 40).alias("short"))


def numbered_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The first three lines of each symbol's text, numbered."""
    symbols = facts.symbols(spark, directory).join(facts.texts(spark, directory), "file_id")
    last = F.least(F.col("end_line"), F.col("start_line") + 2)
    lines = symbols.select("symbol_id", "start_line", F.posexplode(X.line_range(F.col("content"), F.col("start_line"), last)).alias("at", "line"))
    return lines.select("symbol_id", F.concat(F.lpad((F.col("start_line") + F.col("at")).cast("string"), 5, " "), F.lit("| "), F.col("line")).alias("text"))


def generated_filter(spark: SparkSession, directory: str) -> DataFrame:
    return facts.texts(spark, directory).where(X.looks_generated(F.col("content"))).select("file_id")


def fixture_trees(spark: SparkSession, directory: str) -> DataFrame:
    """Test-data trees of two files or more, per repository."""
    return W.fixture_trees(facts.files(spark, directory).select("repo_id", "path"), 2)


def fact_cache_stale(spark: SparkSession, directory: str) -> DataFrame:
    """Scans of files that an earlier scan did not see with the same size and time."""
    scans = table(spark, directory, "files").select("file_id", "path", "bytes", "mtime", "indexed_at").distinct()
    return W.stale(scans).select("file_id", "path", "bytes")


def fingerprint(spark: SparkSession, directory: str) -> DataFrame:
    """One number per repository that changes with any path, size or time."""
    one = facts._newest(table(spark, directory, "files"), "file_id", ["path", "bytes", "mtime", "repo_id"])
    return one.groupBy("repo_id").agg(F.bit_xor(F.xxhash64("path", "bytes", "mtime")).alias("fingerprint"), F.count("*").alias("n"))


def search_pattern_words(spark: SparkSession, directory: str) -> DataFrame:
    return facts.symbols(spark, directory).select(X.hook_words(F.col("signature")).alias("w"), "symbol_id").select("symbol_id", F.array_join("w", " ").alias("words"))


def sql_names(spark: SparkSession, directory: str) -> DataFrame:
    """Package-like names split at their last dot, and their normal spelling."""
    specs = facts.imports(spark, directory).select("spec").distinct()
    s = X.split_name(F.col("spec"))
    return specs.select("spec", s["schema"].alias("head"), s["table"].alias("tail"), X.py_norm(F.col("spec")).alias("norm"))


def score_bands(spark: SparkSession, directory: str) -> DataFrame:
    """Documented share of each repository's files as points and a colour."""
    files = facts.files(spark, directory).groupBy("repo_id").agg(F.avg((F.col("role") == "Test").cast("double")).alias("share"), F.count("*").alias("n"))
    pts = X.points(F.col("share") / 0.4, 15.0)
    return files.select("repo_id", pts.alias("points"), X.colour(F.col("share") * 100).alias("colour"), X.plural(F.col("n"), "file").alias("size"))


QUERIES = {f.__name__: f for f in (
    path_parts, path_normalize, dir_suffixes, common_prefix, pretty_dir, file_kinds, include_override, path_match_share, path_penalty, path_mention, camel_tokens, query_words,
    looks_like_symbol, query_analysis, token_estimate, numbered_lines, generated_filter, fixture_trees, fact_cache_stale, fingerprint, search_pattern_words, sql_names, score_bands)}

_GENERIC = rf"(s IN {S.strings(P.GENERIC_DIRS)} OR s = 'commonJvmAndroid' OR (regexp_matches(s, '^[a-z].*Main$') AND length(s) > 4))"
_PRETTY = f"list_filter(string_split({S.parent('path')}, '/'), lambda s: NOT {_GENERIC})"
_AGREE = """length(CASE WHEN length(w) <= length(p) THEN w ELSE p END) >= 3 AND (starts_with(CASE WHEN length(w) <= length(p) THEN p ELSE w END, CASE WHEN length(w) <= length(p) THEN w ELSE p END)
 OR (length(CASE WHEN length(CASE WHEN length(w) <= length(p) THEN w ELSE p END) > 5 THEN left(CASE WHEN length(w) <= length(p) THEN w ELSE p END, -2) ELSE CASE WHEN length(w) <= length(p) THEN w ELSE p END END) >= 4
 AND starts_with(CASE WHEN length(w) <= length(p) THEN p ELSE w END, CASE WHEN length(CASE WHEN length(w) <= length(p) THEN w ELSE p END) > 5 THEN left(CASE WHEN length(w) <= length(p) THEN w ELSE p END, -2) ELSE CASE WHEN length(w) <= length(p) THEN w ELSE p END END)))"""
_PARTS = f"list_concat({S.tokens('regexp_extract(' + S.name('path') + ', ' + chr(39) + '^([^.]*)' + chr(39) + ', 1)')}, {S.tokens(S.name(S.parent('path')))})"


def _mention(m: str) -> str:
    import re

    f = "lower(path)"
    if re.search(r"[^/.]\.(" + "|".join(X.FILE_EXTENSIONS) + ")$", m):
        whole = f"({f} = '{m}' OR ({'true' if '/' in m else 'false'} AND ends_with({f}, '/{m}')) OR (ends_with('{m}', '/' || {f}) AND contains({f}, '/')))"
        return f"CASE WHEN {whole} THEN 1.0 WHEN {'false' if '/' in m else 'true'} AND ends_with({f}, '/{m}') THEN 0.5 ELSE 0.0 END"
    stem = rf"regexp_replace({f}, '([^/])\.[^.]*$', '\1')"
    pkg = f"CASE WHEN ends_with({stem}, '/__init__') THEN left({stem}, -9) END"
    return f"CASE WHEN {stem} = '{m}' OR ends_with({stem}, '/{m}') THEN 0.8 WHEN {pkg} = '{m}' OR ends_with({pkg}, '/{m}') THEN 0.6 ELSE 0.0 END"


_F = f"WITH {S.FILES}"
_DOCS = "(SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_HEAD = r"left(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '')[1], ''), 300)"
_WORDS = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')"
ORACLES = {
    "path_parts": f"{_F} SELECT file_id, {S.parent('path')} AS dir, {S.name('path')} AS name, {S.ext('path')} AS ext, {S.strip('path')} AS stem FROM files2",
    "path_normalize": f"{_F} SELECT file_id, {S.normalize(S.parent('path') + ' || ' + chr(39) + '/../x//./' + chr(39) + ' || ' + S.name('path'))} AS path FROM files2",
    "dir_suffixes": f"{_F}, d AS (SELECT DISTINCT repo_id, {S.parent('path')} AS dir FROM files2), p AS (SELECT repo_id, dir, string_split(dir, '/') AS ps FROM d) SELECT repo_id, dir, array_to_string(ps[i:], '/') AS suffix FROM p, unnest(range(1, len(ps) + 1)) AS t(i)",
    "common_prefix": f"""{_F}, m AS (SELECT repo_id, min(path) AS fst FROM files2 GROUP BY repo_id), x AS (SELECT file_id, string_split(path, '/') a, string_split(fst, '/') b FROM files2 JOIN m USING (repo_id))
SELECT file_id, CAST(coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS INTEGER) AS shared FROM x""",
    "pretty_dir": f"{_F} SELECT file_id, CASE WHEN len({_PRETTY}) > 3 THEN '…/' || array_to_string({_PRETTY}[-3:], '/') ELSE array_to_string({_PRETTY}, '/') END AS dir FROM files2",
    "file_kinds": f"""{_F} SELECT file_id, lang, (lower({S.name('path')}) IN {S.strings(P.TEXT_NAMES)} OR (contains({S.name('path')}, '.') AND {S.ext('path')} IN {S.strings(P.TEXT_EXTENSIONS)})) AS searchable,
(list_has_any(string_split({S.parent('path')}, '/'), {S.listed(P.IGNORED_DIRS)}) OR regexp_matches(path, '(^|/)\\.[^/]+') OR regexp_matches({S.name('path')}, '{P.IGNORED_FILES}')) AS ignored, is_test, role FROM files2""",
    "include_override": f"{_F} SELECT file_id, path FROM files2 WHERE path IN ('src', 'docs') OR starts_with(path, 'src/') OR starts_with(path, 'docs/')",
    "path_match_share": f"""{_F}, q AS (SELECT {S.words(chr(39) + QUESTION + chr(39))} AS ws), x AS (SELECT file_id, ws, {_PARTS} AS parts FROM files2, q),
h AS (SELECT file_id, len(list_filter(ws, lambda w: len(list_filter(parts, lambda p: {_AGREE})) > 0)) / len(ws) AS share FROM x) SELECT file_id, round(share, 6) AS share FROM h WHERE share >= 0.1""",
    "path_penalty": f"""{_F} SELECT file_id, round((CASE WHEN role = 'Core' THEN 1.0 ELSE 0.3 END)::DOUBLE * (CASE WHEN list_has_any(string_split(lower(path), '/'), ['compat', '_compat', 'legacy']) THEN 0.3 ELSE 1.0 END)
* (CASE WHEN lower({S.name('path')}) IN ('__init__.py', 'package-info.java') THEN 0.5 ELSE 1.0 END) * (CASE WHEN ends_with(lower(path), '.d.ts') THEN 0.7 ELSE 1.0 END) * (CASE WHEN lang IS NULL THEN 0.85 ELSE 1.0 END), 6) AS penalty FROM files2""",
    "path_mention": f"{_F}, m AS (SELECT file_id, greatest({', '.join(_mention(m) for m in MENTIONS)})::DOUBLE AS mention FROM files2) SELECT * FROM m WHERE mention > 0",
    "camel_tokens": f"WITH {S.SYMBOLS} SELECT symbol_id, array_to_string({S.tokens('name')}, ' ') AS words, array_to_string({S.tokens('name')}, '_') AS snake FROM symbols1",
    "query_words": f"SELECT item_id, array_to_string({S.words('text')}, ' ') AS words FROM (SELECT item_id, any_value(text) AS text FROM eval_items GROUP BY item_id)",
    "looks_like_symbol": rf"""WITH {S.SYMBOLS}, n AS (SELECT DISTINCT name FROM symbols1), p AS (SELECT name, list_filter(string_split_regex(name, '[.:\\]'), lambda p: p <> '') ps FROM n)
SELECT name FROM p WHERE len(ps) > 0 AND len(list_filter(ps, lambda p: NOT regexp_matches(p, '^[\p{{L}}\p{{N}}_]+$'))) = 0 AND NOT regexp_matches(name, '\s') AND (len(ps) > 1 OR regexp_matches(name, '^_|[\p{{Lu}}_0-9]'))""",
    "query_analysis": rf"""WITH d AS (SELECT doc_id, text, {_WORDS} AS ws FROM {_DOCS}) SELECT doc_id, {_HEAD} AS head, array_to_string(list_filter(list_filter(ws, lambda w, i: list_position(ws, w) = i),
lambda w: length(w) BETWEEN 3 AND 64 AND (regexp_matches(w, '[A-Za-z0-9]_+[A-Za-z0-9]') OR regexp_matches(w, '[a-z][A-Z]')))[1:48], ' ') AS idents FROM d""",
    "token_estimate": f"SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS n_tokens, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS short FROM {_DOCS}",
    "numbered_lines": f"""WITH {S.SYMBOLS}, {S.TEXTS}, l AS (SELECT symbol_id, greatest(start_line, 1) AS s, start_line, least(end_line, start_line + 2) AS e, string_split(content, chr(10)) AS ls FROM symbols1 JOIN texts1 USING (file_id))
SELECT symbol_id, lpad(CAST(start_line + (i - s) AS VARCHAR), 5, ' ') || '| ' || ls[i] AS text FROM l, unnest(range(s, least(e, len(ls)) + 1)) AS t(i)""",
    "generated_filter": f"""WITH {S.TEXTS}, l AS (SELECT file_id, content, length(content) AS n, greatest(len(string_split(regexp_replace(content, '\\n$', ''), chr(10))), 1) AS k FROM texts1)
SELECT file_id FROM l WHERE contains(left(content, 8192), chr(0)) OR (n > 20000 AND floor(n / k) > 400)""",
    "fixture_trees": f"""{_F}, s AS (SELECT repo_id, path, string_split(path, '/') AS ps FROM files2), d AS (SELECT repo_id, path, ps, i AS depth, array_to_string(ps[:i], '/') AS dir FROM s, unnest(range(1, len(ps))) AS t(i)),
q AS (SELECT repo_id, path, depth, dir FROM d WHERE ps[depth] IN ('testdata', 'fixtures', '__fixtures__', '__snapshots__') OR len(list_filter(range(1, depth), lambda k: ps[k] IN ('test', 'tests', '__tests__', 'spec', 'specs', 'e2e')
  AND ps[k + 1] NOT IN ('src', 'lib', 'source') AND NOT (k > 1 AND ps[k - 1] = 'src'))) > 0),
t AS (SELECT repo_id, dir FROM q GROUP BY repo_id, dir HAVING count(*) >= 2 AND count(*) FILTER ({S.test_name('path')}) * 10 < count(*)),
f AS (SELECT repo_id, path, min_by(dir, depth) AS dir FROM q JOIN t USING (repo_id, dir) GROUP BY repo_id, path) SELECT repo_id, dir, count(*) AS files FROM f GROUP BY repo_id, dir""",
    "fact_cache_stale": """WITH s AS (SELECT DISTINCT file_id, path, bytes, mtime, indexed_at FROM files), p AS (SELECT *, lag(struct_pack(a := path, b := bytes, c := mtime)) OVER (PARTITION BY file_id ORDER BY indexed_at, path, bytes, mtime) AS prev FROM s)
SELECT file_id, path, bytes FROM p WHERE prev IS NULL OR prev.a IS DISTINCT FROM path OR prev.b IS DISTINCT FROM bytes OR prev.c IS DISTINCT FROM mtime""",
    "search_pattern_words": rf"""WITH {S.SYMBOLS}, w AS (SELECT symbol_id, regexp_extract_all(regexp_replace(signature, '\\[a-zA-Z]', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS ws FROM symbols1)
SELECT symbol_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(ws), lambda x: struct_pack(n := -length(x), w := x)))[1:3], lambda r: r.w), ' ') AS words FROM w""",
    "sql_names": rf"""WITH {S.IMPORTS}, d AS (SELECT DISTINCT spec, string_split(regexp_replace(spec, '["`\[\]]', '', 'g'), '.') AS ps FROM imports1)
SELECT spec, CASE WHEN len(ps) > 1 AND lower(ps[-2]) NOT IN ('public', 'main', 'dbo') THEN ps[-2] END AS head, ps[-1] AS tail, translate(lower(spec), '-.', '__') AS norm FROM d""",
    "score_bands": f"""{_F}, s AS (SELECT repo_id, avg((role = 'Test')::INT::DOUBLE) AS share, count(*) AS n FROM files2 GROUP BY repo_id)
SELECT repo_id, CAST(round(least(greatest(share / 0.4, 0), 1) * 15) AS INTEGER) AS points, CASE WHEN share * 100 >= 90 THEN 'brightgreen' WHEN share * 100 >= 75 THEN 'green' WHEN share * 100 >= 60 THEN 'yellowgreen'
WHEN share * 100 >= 40 THEN 'yellow' WHEN share * 100 >= 20 THEN 'orange' ELSE 'red' END AS colour, n || ' file' || CASE WHEN n = 1 THEN '' ELSE 's' END AS size FROM s""",
}
