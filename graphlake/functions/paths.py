"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which extension names which language.
LANGUAGES = {
    "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "Tsx", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript",
    "py": "Python", "pyi": "Python", "go": "Go", "rs": "Rust", "java": "Java", "c": "C", "h": "C", "cc": "Cpp", "cpp": "Cpp", "cxx": "Cpp", "hpp": "Cpp", "hh": "Cpp",
    "hxx": "Cpp", "ipp": "Cpp", "inl": "Cpp", "cs": "CSharp", "rb": "Ruby", "rake": "Ruby", "php": "Php", "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift"}
# Names and extensions of text that is worth searching.
TEXT_NAMES = "dockerfile makefile justfile gemfile rakefile procfile readme".split()
TEXT_EXTENSIONS = (
    "md mdx txt rst adoc yaml yml toml json jsonc ini cfg sh bash zsh fish ps1 sql proto graphql gql prisma html css scss less vue svelte astro "
    "scala lua ex exs erl dart zig nim hs ml clj r jl tf hcl nix gradle cmake xml").split()
# Directories and file names that are not read.
IGNORED_DIRS = (
    "node_modules bower_components vendor third_party dist build out target coverage __pycache__ .venv venv .tox .mypy_cache .pytest_cache .next "
    ".nuxt .svelte-kit .turbo .cache .gradle .idea .vscode Pods DerivedData").split()
IGNORED_FILES = r"(\.min\.js|\.min\.css|\.map|\.lock|^package-lock\.json|^pnpm-lock\.yaml|^yarn\.lock|^bun\.lockb|\.pb\.go|_pb2\.py|\.generated\..*|\.snap)$"
# Words that give a directory its role, and names of test directories.
ROLE_WORDS = {
    "Example": "example examples sample samples demo demos playground playgrounds showcase tutorial tutorials".split(),
    "Doc": "docs doc documentation website".split(),
    "Bench": "bench benches benchmark benchmarks".split(),
    "Test": "test tests spec specs testdata fixtures e2e testing".split()}
TEST_DIRS = "test tests __tests__ spec specs testdata e2e".split()
GENERIC_DIRS = ["", *"src lib pkg internal source sources packages crates (root) main java kotlin scala go python".split()]


def plain(path: Column) -> Column:
    """Forward slashes, no leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def parent_dir(path: Column) -> Column:
    """What stands before the last slash; '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the path; '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def strip_ext(path: Column) -> Column:
    """The path up to the first dot of its file name."""
    return F.regexp_replace(path, r"\.[^/]*$", "")


def normalize(path: Column) -> Column:
    """Folds empty, . and .. segments; .. above the root is dropped."""

    def step(done: Column, segment: Column) -> Column:
        up = F.regexp_replace(done, r"(^|/)[^/]*$", "")
        return F.when(segment.isin("", "."), done).when(segment == "..", up).when(done == "", segment).otherwise(F.concat(done, F.lit("/"), segment))

    return F.aggregate(F.split(path, "/"), F.lit(""), step)


def join(directory: Column, relative: Column) -> Column:
    return normalize(F.concat(directory, F.lit("/"), relative))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading segments two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) != F.element_at(y, i))
    return F.when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(n)


def dir_suffixes(directory: Column) -> Column:
    """Every trailing run of segments, the whole first: a/b/c, b/c, c."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def dir_prefixes(directory: Column) -> Column:
    """Every leading run of segments: a, a/b, a/b/c; none for the root."""
    parts = F.filter(F.split(directory, "/"), lambda s: s != "")
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def is_generic_dir(segment: Column) -> Column:
    return segment.isin(*GENERIC_DIRS) | (segment == "commonJvmAndroid") | (segment.rlike("^[a-z].*Main$") & (F.length(segment) > 4))


def pretty_dir(directory: Column) -> Column:
    """A directory without generic segments, at most its last three."""
    parts = F.filter(F.split(directory, "/"), lambda s: ~is_generic_dir(s))
    return F.when(F.size(parts) > 3, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -3, 3), "/"))).otherwise(F.array_join(parts, "/"))


def language(path: Column) -> Column:
    """The language that the extension names, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(path.rlike(r"\."), F.element_at(table, extension(path)))


def searchable_text(path: Column) -> Column:
    """Whether a file without a language is worth searching."""
    name = F.lower(file_name(path))
    return name.isin(*TEXT_NAMES) | (name.rlike(r"\.") & extension(path).isin(*TEXT_EXTENSIONS))


def ignored(path: Column) -> Column:
    """Whether default rules leave a file out: an ignored or hidden directory or name."""
    parts = F.split(parent_dir(path), "/")
    hidden = path.rlike(r"(^|/)\.[^/]+")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in IGNORED_DIRS])) | hidden | file_name(path).rlike(IGNORED_FILES)


def has_test_name(path: Column) -> Column:
    """Whether the file name is one of a test."""
    name, original = F.lower(file_name(path)), file_name(path)
    return (
        name.rlike(r"^test_.*\.(py|rb|c|cc|cpp|lua|dart|php)$") | name.rlike(r"\.test\.|\.spec\.|_test\.|_spec\.")
        | original.rlike(r"(Test|Tests|Spec|IT)\.([jJ][aA][vV][aA]|[kK][tT]|[kK][tT][sS]|[sS][cC][aA][lL][aA]|[gG][rR][oO][oO][vV][yY]|[pP][hH][pP]|[cC][sS]|[sS][wW][iI][fF][tT])$"))


def is_test_path(path: Column) -> Column:
    """Whether a path has a test directory or a test's name."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(d) for d in TEST_DIRS])) | has_test_name(path)


def role(path: Column, is_test: Column) -> Column:
    """Example, Doc, Bench or Test by the first directory word that says so; else Test for tests, else Core."""
    from graphlake.functions.text import tokens

    words = F.flatten(F.transform(F.split(parent_dir(path), "/"), tokens))
    table = F.create_map(*[F.lit(x) for name, ws in ROLE_WORDS.items() for w in ws for x in (w, name)])
    named = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda r: r.isNotNull())
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.when(is_test, "Test").otherwise("Core"))


def under(path: Column, prefix: Column) -> Column:
    """Whether a path is a directory or below it."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def path_penalty(path: Column, file_role: Column, lang: Column) -> Column:
    """The factor by which tests, examples, shims and re-export files rank lower."""
    low = F.lower(path)
    name = file_name(low)
    shim = F.arrays_overlap(F.split(low, "/"), F.array(F.lit("compat"), F.lit("_compat"), F.lit("legacy")))
    return (
        F.when(file_role == "Core", 1.0).otherwise(0.3) * F.when(shim, 0.3).otherwise(1.0) * F.when(name.isin("__init__.py", "package-info.java"), 0.5).otherwise(1.0)
        * F.when(name.endswith(".d.ts"), 0.7).otherwise(1.0) * F.when(lang.isNull(), 0.85).otherwise(1.0))


def path_match(path: Column, words: Column) -> Column:
    """The share of query words that agree with a part of the file's name or parent directory; below 0.1 it is 0.

    They agree if the shorter, of three letters or more, begins the longer, or what is left of it without its
    last two letters (if longer than five) does and has four letters.
    """
    from graphlake.functions.text import tokens

    stem = F.regexp_extract(file_name(path), r"^([^.]*)", 1)
    parts = F.concat(tokens(stem), tokens(file_name(parent_dir(path))))

    def agree(word: Column, part: Column) -> Column:
        first = F.length(word) <= F.length(part)
        short, long = F.when(first, word).otherwise(part), F.when(first, part).otherwise(word)
        cut = F.when(F.length(short) > 5, F.substr(short, F.lit(1), F.length(short) - 2)).otherwise(short)
        return (F.length(short) >= 3) & (long.startswith(short) | (long.startswith(cut) & (F.length(cut) >= 4)))

    hits = F.size(F.filter(words, lambda w: F.exists(parts, lambda p: agree(w, p))))
    share = hits / F.greatest(F.size(words), F.lit(1))
    return F.when(share >= 0.1, share).otherwise(0.0)


def path_mention(path: Column, mention: Column) -> Column:
    """How strongly a (lower-case) mention names a file: 1.0 its path, 0.8 its module, 0.6 its package, 0.5 its bare name."""
    from graphlake.functions.text import FILE_EXTENSIONS

    f = F.lower(path)
    stem = F.regexp_replace(f, r"(?<=[^/])\.[^.]*$", "")
    last = file_name(mention)
    named = last.rlike(r"^.+\.(" + "|".join(FILE_EXTENSIONS) + ")$")
    below = f.endswith(F.concat(F.lit("/"), mention))
    whole = (f == mention) | (mention.contains("/") & below) | (mention.endswith(F.concat(F.lit("/"), f)) & f.contains("/"))
    package = F.when(stem.endswith("/__init__"), F.regexp_replace(stem, "/__init__$", ""))
    ends = lambda x: (x == mention) | x.endswith(F.concat(F.lit("/"), mention))
    return F.when(named, F.when(whole, 1.0).when(~mention.contains("/") & below, 0.5).otherwise(0.0)).when(ends(stem), 0.8).when(ends(package), 0.6).otherwise(0.0)
