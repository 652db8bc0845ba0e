"""Pieces of DuckDB SQL that the checks share."""

from __future__ import annotations

from graphlake.functions import paths as P
from graphlake.functions import text as X


def strings(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def listed(values) -> str:
    return "[" + strings(values)[1:-1] + "]"


def plain(x: str) -> str:
    return rf"regexp_replace(replace({x}, '\', '/'), '^(\./)+', '')"


def parent(x: str) -> str:
    return f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"


def name(x: str) -> str:
    return f"regexp_extract({x}, '([^/]*)$', 1)"


def ext(x: str) -> str:
    return rf"lower(regexp_extract({x}, '\.([^.]*)$', 1))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\.[^/]*$', '')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+')"


def lang(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items())
    return f"CASE WHEN contains({x}, '.') THEN CASE {ext(x)} {whens} END END"


def test_name(x: str) -> str:
    n = f"lower({name(x)})"
    return (
        rf"(regexp_matches({n}, '^test_.*\.(py|rb|c|cc|cpp|lua|dart|php)$') OR regexp_matches({n}, '\.test\.|\.spec\.|_test\.|_spec\.') "
        rf"OR regexp_matches({name(x)}, '(Test|Tests|Spec|IT)\.(?i:java|kt|kts|scala|groovy|php|cs|swift)$'))")


def is_test(x: str) -> str:
    return f"(list_has_any(string_split(lower({x}), '/'), {listed(P.TEST_DIRS)}) OR {test_name(x)})"


def role(x: str) -> str:
    words = f"flatten(list_transform(string_split({parent(x)}, '/'), lambda s: {tokens('s')}))"
    whens = " ".join(f"WHEN w IN {strings(ws)} THEN '{r}'" for r, ws in P.ROLE_WORDS.items())
    return f"coalesce(list_filter(list_transform({words}, lambda w: CASE {whens} END), lambda r: r IS NOT NULL)[1], CASE WHEN {is_test(x)} THEN 'Test' ELSE 'Core' END)"


def normalize(x: str) -> str:
    return (
        f"list_reduce(string_split({x}, '/'), lambda d, s: CASE WHEN s IN ('', '.') THEN d WHEN s = '..' THEN regexp_replace(d, '(^|/)[^/]*$', '') "
        "WHEN d = '' THEN s ELSE d || '/' || s END, '')")


def words(x: str) -> str:
    """Distinct query words in order."""
    return (
        f"list_filter(list_filter({tokens(x)}, lambda w, i: list_position({tokens(x)}, w) = i), lambda w: length(w) >= 3 AND w NOT IN {strings(X.STOPWORDS)})")


FILES = f"""files1 AS (SELECT file_id, repo_id, {plain('path')} AS path, lines, bytes FROM (SELECT *, row_number() OVER (PARTITION BY file_id
  ORDER BY indexed_at DESC, path DESC, lines DESC, bytes DESC, repo_id DESC) rn FROM files WHERE file_id IS NOT NULL) WHERE rn = 1 AND path IS NOT NULL),
files2 AS (SELECT *, {lang('path')} AS lang, {is_test('path')} AS is_test, {role('path')} AS role FROM files1)"""
SYMBOLS = """symbols1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY indexed_at DESC, file_id DESC, name DESC, kind DESC,
  start_line DESC, end_line DESC, owner DESC, parent DESC, signature DESC, repo_id DESC) rn FROM symbols WHERE symbol_id IS NOT NULL) WHERE rn = 1)"""
CALLS = "calls1 AS (SELECT DISTINCT * FROM calls WHERE call_id IS NOT NULL)"
IMPORTS = """imports1 AS (SELECT DISTINCT repo_id, file_id, trim(regexp_replace(spec, '["''`<>;]', '', 'g')) AS spec FROM imports
  WHERE file_id IS NOT NULL AND trim(regexp_replace(spec, '["''`<>;]', '', 'g')) <> '')"""
TEXTS = "texts1 AS (SELECT file_id, any_value(content) AS content FROM file_texts WHERE content IS NOT NULL AND file_id IS NOT NULL GROUP BY file_id)"
CHUNKS = """chunks1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, file_id DESC, start_line DESC) rn
  FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"""
