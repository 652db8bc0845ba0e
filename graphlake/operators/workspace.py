"""Several repositories as one: packages that one publishes and others consume, and what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.functions import text as X


def published(manifests: DataFrame) -> DataFrame:
    """(repo_id, kind, key, dir) from manifests (repo_id, path, content): npm, cargo, go and python names."""
    name = P.file_name(F.col("path"))
    directory = P.parent_dir(F.col("path"))
    section = lambda s: F.regexp_extract("content", rf'(?s)\[{s}\][^\[]*?\bname\s*=\s*"([^"]+)"', 1)
    cargo = F.when(section("lib") != "", section("lib")).otherwise(section("package"))
    python = F.when(section("project") != "", section("project")).otherwise(section(r"tool\.poetry"))
    key = (
        F.when(name == "package.json", F.get_json_object("content", "$.name")).when(name == "Cargo.toml", F.replace(cargo, F.lit("-"), F.lit("_")))
        .when(name == "go.mod", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1)).when(name == "pyproject.toml", X.py_norm(python)))
    kind = F.when(name == "package.json", "npm").when(name == "Cargo.toml", "cargo").when(name == "go.mod", "go").when(name == "pyproject.toml", "python")
    return manifests.where(~F.col("path").contains("node_modules/")).select("repo_id", kind.alias("kind"), key.alias("key"), directory.alias("dir")).where("kind IS NOT NULL AND key <> ''").distinct()


def consumed(imports: DataFrame) -> DataFrame:
    """(repo_id, file_id, kind, key, sub, ord): the packages that an import may mean, the likeliest first.

    imports: repo_id, file_id, lang, spec.
    """
    spec = F.col("spec")
    npm = imports.where(F.col("lang").isin("JavaScript", "TypeScript", "Tsx") & ~spec.rlike(r"^(\.|/|node:|[@~]/)")).select(
        "repo_id", "file_id", F.lit("npm").alias("kind"), F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^/]+)", 1).alias("key"), F.regexp_extract(spec, r"^(?:@[^/]+/[^/]+|[^/]+)/(.+)$", 1).alias("sub"), F.lit(0).alias("ord"))
    crate = F.element_at(F.split(spec, "::"), 1)
    cargo = imports.where((F.col("lang") == "Rust") & ~crate.isin("std", "core", "alloc", "crate", "self", "super") & ~spec.startswith("mod:")).select(
        "repo_id", "file_id", F.lit("cargo").alias("kind"), crate.alias("key"), F.lit("").alias("sub"), F.lit(0).alias("ord"))
    steps = F.split(spec, "/")
    go = imports.where((F.col("lang") == "Go") & spec.contains("/") & spec.contains(".")).select(
        "repo_id", "file_id", F.posexplode(F.transform(F.sequence(F.size(steps), F.lit(2), F.lit(-1)), lambda k: F.struct(F.array_join(F.slice(steps, F.lit(1), k), "/").alias("key"), F.array_join(F.slice(steps, k + 1, F.size(steps)), "/").alias("sub")))).alias("ord", "c")
    ).select("repo_id", "file_id", F.lit("go").alias("kind"), "c.key", "c.sub", "ord")
    first = F.element_at(F.split(spec, r"\."), 1)
    python = imports.where((F.col("lang") == "Python") & ~spec.startswith(".")).select(
        "repo_id", "file_id", F.lit("python").alias("kind"), X.py_norm(first).alias("key"), F.replace(F.regexp_extract(spec, r"^[^.]+\.(.+)$", 1), F.lit("."), F.lit("/")).alias("sub"), F.lit(0).alias("ord"))
    return npm.unionByName(cargo).unionByName(go).unionByName(python)


def cross_edges(packages: DataFrame, uses: DataFrame, first_match_only: bool = False) -> DataFrame:
    """(from_repo, from_file, kind, package, sub, to_repo, dir): uses of packages that another repository publishes.

    A package that several publish is the first's.  Each file has one edge per package it uses, by its likeliest
    candidate; first_match_only leaves one edge per file and kind.
    """
    owner = packages.groupBy("kind", "key").agg(F.min(F.struct("repo_id", "dir")).alias("o")).select("kind", "key", F.col("o.repo_id").alias("to_repo"), F.col("o.dir").alias("dir"))
    met = uses.join(owner, ["kind", "key"]).where(F.col("repo_id") != F.col("to_repo"))
    group = ["repo_id", "file_id", "kind"] if first_match_only else ["repo_id", "file_id", "kind", "key", "sub"]
    order = Window.partitionBy(*group).orderBy("ord", "key", "sub")
    return met.withColumn("at", F.row_number().over(order)).where("at = 1").select(
        F.col("repo_id").alias("from_repo"), F.col("file_id").alias("from_file"), "kind", F.col("key").alias("package"), F.when(F.col("sub") != "", F.col("sub")).alias("sub"), "to_repo", "dir")


def importers_of(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, from_repo, from_file): who of other repositories uses each file, through the deepest package around it."""
    packages = edges.select("to_repo", "kind", "package", "dir").distinct()
    up = files.select(F.col("repo_id").alias("to_repo"), "file_id", "path", F.explode(F.concat(F.array(F.lit("")), P.dir_prefixes(P.parent_dir(F.col("path"))))).alias("dir"))
    deepest = up.join(packages, ["to_repo", "dir"]).groupBy("to_repo", "file_id", "path", "kind").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "package")).alias("p")).select("to_repo", "file_id", "path", "kind", F.col("p.dir").alias("dir"), F.col("p.package").alias("package"))
    inner = P.strip_ext(F.when(F.col("dir") == "", F.col("path")).otherwise(F.substr("path", F.length("dir") + 2)))
    met = deepest.withColumn("inner", inner).join(edges.select("to_repo", "kind", "package", "sub", "from_repo", "from_file"), ["to_repo", "kind", "package"])
    return met.where(X.sub_matches(F.col("sub"), F.col("inner"))).select("file_id", "from_repo", "from_file").distinct()


def repository_links(edges: DataFrame) -> DataFrame:
    """(from_repo, to_repo, files): how many files of one repository use another."""
    return edges.groupBy("from_repo", "to_repo").agg(F.countDistinct("from_file").alias("files"))


def spread(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, repo_id, hop): the repositories that depend on each query's, directly or through others, within `hops`."""
    links = edges.select(F.col("to_repo").alias("repo_id"), F.col("from_repo").alias("next")).distinct()
    here = start.select("query_id", "repo_id").withColumn("hop", F.lit(0))
    done = here
    for k in range(1, hops + 1):
        new = here.join(links, "repo_id").select("query_id", F.col("next").alias("repo_id")).distinct()
        here = new.join(done.select("query_id", "repo_id"), ["query_id", "repo_id"], "left_anti").withColumn("hop", F.lit(k)).checkpoint()
        done = done.unionByName(here)
    return done.where("hop > 0")
