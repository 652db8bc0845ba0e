"""Reading repositories: files of a tree, git state, change hunks, manifests and workspaces."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.functions import text as X

MOST_BYTES = 1_000_000


def ignore_pattern(line: str, base: str = "") -> tuple[str, bool] | None:
    """(regular expression over paths, whether it takes back) of one line of an ignore file in directory `base`."""
    rule = line.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule[1:] if back else rule
    anchored = "/" in rule.rstrip("/")
    rule = rule.lstrip("/")
    only_dir = rule.endswith("/")
    out, i, rule = "", 0, rule.rstrip("/")
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    head = "^" + (re.escape(base) + "/" if base else "") + ("" if anchored else "(?:.*/)?")
    return head + out + ("/" if only_dir else "(?:/|$)"), back


def _scan(root: str, names: tuple[str, ...] | None):
    """Reads the files of directories: of a row (directory, deep) those in it, and, if deep, those below.

    Spark's own readers pass over names that begin with _ or ., such as __init__.py, so the listing is done here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for directory, deep in zip(batch["directory"], batch["deep"], strict=True):
                rows = []
                for info in system.get_file_info(fs.FileSelector(directory, recursive=bool(deep))):
                    if info.type != fs.FileType.File or (names is not None and info.base_name not in names) or "/.git/" in info.path:
                        continue
                    content = None
                    if 0 < info.size <= MOST_BYTES:
                        with system.open_input_stream(info.path) as stream:
                            content = stream.read()
                    rows.append((info.path[len(base.rstrip("/")) + 1 :], info.size, info.mtime, content))
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=["path", "bytes", "mtime", "content"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "bytes", "mtime", "content"])

    return run


def read_tree(spark: SparkSession, root: str, ignore_files: tuple[str, ...] = (".gitignore", ".repoignore")) -> DataFrame:
    """(path, bytes, mtime, content) of the code and searchable text below a directory, without ignored, empty and large files.

    The directories right below the root are listed and read in parallel, where the executors can reach it.  Of
    the rules in ignore files, the last that matches counts, those of deeper files coming last.
    """
    from pyarrow import fs

    uri = root if "://" in root else Path(root).resolve().as_uri()
    system, base = fs.FileSystem.from_uri(uri)
    below = sorted(i.path for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory and i.base_name not in (".git", *P.IGNORED_DIRS))
    places = spark.createDataFrame([(base, False), *((d, True) for d in below)], "directory string, deep boolean").repartition(max(1, min(len(below) + 1, 1_000)))
    shape = "path string, bytes long, mtime timestamp, content binary"
    rules = []
    for row in places.mapInPandas(_scan(uri, ignore_files), shape).select("path", F.col("content").cast("string").alias("text")).where("text IS NOT NULL").orderBy(F.size(F.split("path", "/")), "path").collect():
        directory = row["path"].rpartition("/")[0]
        rules += [r for r in (ignore_pattern(line, directory) for line in row["text"].splitlines()) if r]
    left_out = F.lit(False)
    for pattern, back in rules:
        left_out = F.when(F.col("path").rlike(pattern), F.lit(not back)).otherwise(left_out)
    named = places.mapInPandas(_scan(uri, None), shape)
    wanted = (P.language(F.col("path")).isNotNull() | P.searchable_text(F.col("path"))) & ~P.ignored(F.col("path")) & ~left_out & F.col("bytes").between(1, MOST_BYTES)
    return named.where(wanted).select("path", "bytes", "mtime", F.col("content").cast("string").alias("content")).where(~X.looks_generated(F.col("content")))


def git(root: str, *args: str) -> str | None:
    """The output of a git command that reads only, or null."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def web_address(remote: str | None) -> str | None:
    """The web address of a remote without credentials and .git; null if it is none."""
    if not remote:
        return None
    short = re.sub(r"^(?:ssh://)?[\w.-]+@([^:/]+)[:/](.+)$", r"https://\1/\2", remote)
    clean = re.sub(r"(\.git)?/?$", "", re.sub(r"^(https?://)[^/@]*@", r"\1", short))
    return clean if clean.startswith(("http://", "https://")) else None


def git_state(root: str) -> dict:
    return {"commit": git(root, "rev-parse", "HEAD"), "branch": git(root, "rev-parse", "--abbrev-ref", "HEAD"), "web": web_address(git(root, "remote", "get-url", "origin"))}


def check_ref(ref: str) -> str:
    """A revision's name; one that git would read as an option is refused."""
    if not ref or ref.startswith("-") or re.search(r"[\s\0]", ref):
        raise ValueError(f"no revision: {ref!r}")
    return ref


def hunks(diff: str) -> list[tuple[str, int, int]]:
    """(path, first, last) of the changed lines of a diff without context; a pure deletion counts as the line before it."""
    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            path = None if name == "/dev/null" else re.sub(r"^b/", "", name)
        elif path and (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)):
            start, n = int(m.group(1)), int(m.group(2) or 1)
            out.append((path, max(start, 1), max(start + max(n, 1) - 1, 1)))
    return out


def changed(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """(path, first, last): lines changed since a revision; untracked files as a whole (last null)."""
    rows = hunks(git(root, "diff", "-U0", "--no-color", check_ref(base), "--") or "")
    fresh = [(p, 1, None) for p in (git(root, "ls-files", "--others", "--exclude-standard") or "").splitlines() if p]
    return spark.createDataFrame([*rows, *fresh], "path string, first int, last int")


def workspace_roots(text: str) -> list[str]:
    """The roots of a workspace file: `roots = ["a", "b"]`."""
    m = re.search(r"(?ms)^\s*roots\s*=\s*\[(.*?)\]", re.sub(r"(?m)#.*$", "", text))
    return re.findall(r'"([^"]*)"', m.group(1)) if m else []


def find_upwards(start: str, name: str) -> str | None:
    """The nearest file of that name in a directory or above it."""
    here = Path(start).resolve()
    return next((str(d / name) for d in (here, *here.parents) if (d / name).is_file()), None)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a table beside its place and then puts it there, so that a reader sees the old one or the new one."""
    spark = df.sparkSession
    jvm = spark._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fresh, target, old = fs_path(path + ".new"), fs_path(path), fs_path(path + ".old")
    df.write.mode("overwrite").parquet(path + ".new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def stale_paths(now: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `now` (path, bytes, mtime) whose facts are not among `kept` with the same path, size and time."""
    return now.join(kept.select("path", "bytes", "mtime").distinct(), ["path", "bytes", "mtime"], "left_anti")
