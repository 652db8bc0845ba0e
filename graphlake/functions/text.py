"""Column functions over text, names and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a query that say nothing.
STOPWORDS = (
    "a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with into its this that").split()
# Extensions that make a dotted token a file name.
FILE_EXTENSIONS = (
    "py pyi js jsx ts tsx mjs cjs rs go java kt rb php c h cc cpp hpp cs swift scala rst md txt toml yaml yml json cfg ini html css vue sh").split()


def tokens(text: Column) -> Column:
    """Lower-case words in order: camelCase, snake_case and punctuation separate them; no stemming."""
    humps = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_extract_all(F.lower(humps), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: Column) -> Column:
    """The distinct words of a query, of three letters or more, in order, without stopwords."""
    return F.filter(F.array_distinct(tokens(text)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def looks_like_symbol(query: Column) -> Column:
    """A bare, perhaps qualified, identifier rather than words."""
    parts = F.filter(F.split(query, r"[.:\\]"), lambda p: p != "")
    fit = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^[\p{L}\p{N}_]+$")) & ~query.rlike(r"\s")
    return fit & ((F.size(parts) > 1) | query.rlike(r"^_|[\p{Lu}_0-9]"))


def estimate_tokens(text: Column) -> Column:
    """One for every four characters, rounded up."""
    return F.ceil(F.char_length(text) / 4)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, inclusive) of a text, clamped to it, as an array."""
    lines = F.split(text, "\n")
    start = F.greatest(first, F.lit(1))
    return F.when(start > F.size(lines), F.array().cast("array<string>")).otherwise(
        F.slice(lines, start, F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0))))


def looks_generated(text: Column) -> Column:
    """A zero byte near the start, or more than 20,000 characters in lines of more than 400 on average."""
    lines = F.greatest(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")), F.lit(1))
    return (F.instr(F.left(text, F.lit(8192)), "\0") > 0) | ((F.length(text) > 20_000) & (F.floor(F.length(text) / lines) > 400))


def split_name(name: Column) -> Column:
    """(schema, table) of a dotted SQL name without quotes; default schemas count as none."""
    bare = F.regexp_replace(name, r'["`\[\]]', "")
    parts = F.split(bare, r"\.")
    schema = F.when(F.size(parts) > 1, F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1)))
    return F.struct(F.when(~F.lower(schema).isin("public", "main", "dbo"), schema).alias("schema"), F.element_at(parts, -1).alias("table"))


def snake_case(name: Column) -> Column:
    return F.array_join(tokens(name), "_")


def py_norm(name: Column) -> Column:
    """A Python project name as others may spell it: lower case, - and . as _."""
    return F.translate(F.lower(name), "-.", "__")


def sub_matches(wanted: Column, sub: Column) -> Column:
    """Whether a path inside a package is meant by a sub-path of an import."""
    return wanted.isNull() | (sub == wanted) | sub.startswith(F.concat(wanted, F.lit("/")))


def remote_to_web(remote: Column) -> Column:
    """The web address of a git remote, without credentials and .git; null if it is none."""
    short = F.regexp_replace(remote, r"^(?:ssh://)?[\w.-]+@([^:/]+)[:/](.+)$", "https://$1/$2")
    clean = F.regexp_replace(F.regexp_replace(short, r"^(https?://)[^/@]*@", "$1"), r"(\.git)?/?$", "")
    return F.when(clean.rlike("^https?://"), clean)


def hook_words(pattern: Column) -> Column:
    """The three longest words of a search pattern, of three letters or more, escapes left out."""
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(pattern, r"\\[a-zA-Z]", " "), F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda r: r["w"]), 1, 3)


def points(value: Column, most: float) -> Column:
    """A score between 0 and most, rounded to a whole number."""
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * most).cast("int")


def colour(score: Column) -> Column:
    """The band of a score out of 100."""
    return F.when(score >= 90, "brightgreen").when(score >= 75, "green").when(score >= 60, "yellowgreen").when(score >= 40, "yellow").when(score >= 20, "orange").otherwise("red")


def query_head(text: Column) -> Column:
    """The first line with text, at most 300 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.left(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), F.lit(300))


def code_words(text: Column) -> Column:
    """Distinct identifiers of a text in order: an inner underscore, or a small letter before a capital one."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(w) <= 64) & (w.rlike(r"[A-Za-z0-9]_+[A-Za-z0-9]") | w.rlike(r"[a-z][A-Z]"))), 1, 48)


def mentions(text: Column) -> Column:
    """Lower-case file and module paths that a text names, distinct, at most 24."""
    raw = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"^[.,;:'\"()\[\]{}<>`*]+|[.,;:'\"()\[\]{}<>`*]+$", ""), r"[#?].*$", ""), r":\d+$", ""))
    plain = F.filter(F.transform(bare, lambda w: F.regexp_replace(F.replace(w, F.lit("\\"), F.lit("/")), r"^(\./)+", "")), lambda w: w.rlike(r"^[A-Za-z0-9_/.@+-]{3,200}$"))
    named = F.transform(plain, lambda w: F.when(w.rlike(r"(?i)(^|/)[^/]+\.(" + "|".join(FILE_EXTENSIONS) + ")$"), F.lower(w)).when(w.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$"), F.lower(F.replace(w, F.lit("."), F.lit("/")))))
    return F.slice(F.array_distinct(F.filter(named, lambda w: w.isNotNull())), 1, 24)
