"""Queries over the definition trees of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.operators.hierarchy import circle_descendants, circles, descendant_counts, descendants, hierarchy, symbol_links
from graphlake.plans.session import shared_folder
from graphlake.sources.tables import table

DEEP = 6


def _tree(spark: SparkSession, directory: str, paths: bool) -> DataFrame:
    shared_folder(spark)
    return hierarchy(symbol_links(table(spark, directory, "symbols")), "symbol_id", "parent", near="file_id", paths=paths)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Symbols at least six steps below their root, or in or below a circle, with the root or the circle's least id."""
    tree = _tree(spark, directory, paths=False)
    return tree.where(F.col("in_cycle") | (F.col("depth") >= DEEP)).select("symbol_id", "root_id")


def p4_hierarchy(spark: SparkSession, directory: str) -> DataFrame:
    """Every symbol's root, depth, path and number of descendants."""
    tree = descendant_counts(_tree(spark, directory, paths=True), "symbol_id")
    return tree.select("symbol_id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "n_descendants", "in_cycle")


def p4_descendants(spark: SparkSession, directory: str) -> DataFrame:
    """Every symbol with each symbol below it and the steps between them, on circles too."""
    links, tree = symbol_links(table(spark, directory, "symbols")), _tree(spark, directory, paths=True)
    return descendants(tree, "symbol_id").unionByName(circle_descendants(tree, links, "symbol_id", "parent"))


def p4_circles(spark: SparkSession, directory: str) -> DataFrame:
    """The links that go in circles, with the circle's least id."""
    links, tree = symbol_links(table(spark, directory, "symbols")), _tree(spark, directory, paths=False)
    return circles(tree, links, "symbol_id", "parent")


_LINKS = """
one AS (SELECT symbol_id, max(file_id) file_id, max(name) AS name, max(kind) kind, max(owner) AS owner, max(parent) parent FROM symbols
  WHERE symbol_id IS NOT NULL GROUP BY symbol_id),
owners AS (SELECT file_id, name AS owner, min(symbol_id) owner_id FROM one WHERE name IS NOT NULL AND kind IN ('class','struct','interface','trait','enum','module')
  GROUP BY file_id, name HAVING count(*) = 1),
links AS (SELECT o.symbol_id, k.symbol_id AS parent FROM (SELECT o.symbol_id, coalesce(o.parent, w.owner_id) parent FROM one o
  LEFT JOIN owners w ON w.file_id = o.file_id AND w.owner = o.owner) o LEFT JOIN one k ON k.symbol_id = o.parent),
up AS (SELECT symbol_id, symbol_id AS top, 0 AS depth, CAST(symbol_id AS VARCHAR) AS path, false AS looped, [symbol_id] AS seen FROM links
  UNION ALL SELECT u.symbol_id, l.parent, u.depth + 1, CAST(l.parent AS VARCHAR) || '/' || u.path, list_contains(u.seen, l.parent), list_append(u.seen, l.parent)
  FROM up u JOIN links l ON l.symbol_id = u.top WHERE NOT u.looped AND l.parent IS NOT NULL),
last AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY depth DESC) = 1),
placed AS (SELECT symbol_id, CASE WHEN looped THEN list_min(seen[list_position(seen, top):]) ELSE top END AS root_id, depth, path, looped FROM last)
"""

ORACLES = {
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT CAST(symbol_id AS BIGINT) symbol_id, CAST(root_id AS BIGINT) root_id FROM placed WHERE looped OR depth >= 6",
    "p4_hierarchy": f"""WITH RECURSIVE {_LINKS},
below AS (SELECT CAST(a AS BIGINT) a, count(*) n FROM (SELECT u.top AS a, u.symbol_id FROM up u JOIN placed p USING (symbol_id) WHERE NOT p.looped AND u.depth > 0) GROUP BY a)
SELECT CAST(p.symbol_id AS BIGINT) symbol_id, CAST(root_id AS BIGINT) root_id, CASE WHEN NOT looped THEN CAST(depth AS BIGINT) END AS depth, CASE WHEN NOT looped THEN path END AS path,
  CASE WHEN NOT looped THEN coalesce(n, 0) END AS n_descendants, looped AS in_cycle FROM placed p LEFT JOIN below b ON b.a = p.symbol_id""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS} SELECT CAST(top AS BIGINT) ancestor_id, CAST(symbol_id AS BIGINT) descendant_id, CAST(depth AS BIGINT) distance
FROM up WHERE depth > 0 AND NOT looped""",
    "p4_circles": f"""WITH RECURSIVE {_LINKS} SELECT CAST(symbol_id AS BIGINT) symbol_id, CAST(parent AS BIGINT) parent, CAST(root_id AS BIGINT) root_id
FROM placed JOIN links USING (symbol_id) JOIN (SELECT symbol_id FROM last WHERE looped AND top = symbol_id) USING (symbol_id)""",
}
QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants, "p4_circles": p4_circles}
