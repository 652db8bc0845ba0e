"""Source files that nobody wrote by hand for their repository: generated, minified, vendored, or data as code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.shards import shared_folder, spread
from graphlake.sources.tables import latest, table


@dataclass(frozen=True)
class Layout:
    """Thresholds of one language; shares are of the characters, for numbers of those that are not white."""

    mean_line: float = 90.0
    max_line: int = 2_000
    white: float = 0.08
    alnum: float = 0.40
    numbers: float = 0.60
    runs: float = 0.40
    numbered_lines: float = 0.60


# Tuned per language: what is unusual layout in one is usual in another.
DEFAULT = Layout()
LAYOUTS = {
    "js": Layout(mean_line=80.0, max_line=1_000), "mjs": Layout(mean_line=80.0, max_line=1_000), "jsx": Layout(mean_line=90.0, max_line=1_000),
    "ts": Layout(mean_line=90.0, max_line=1_200), "go": Layout(white=0.06), "py": Layout(white=0.07, mean_line=100.0),
    "java": Layout(mean_line=110.0), "rs": Layout(), "c": Layout(numbers=0.65),
}
# Below this many characters layout says nothing.
LEAST_CHARS = 200
SHINGLE, PERMUTATIONS, BANDS, LEAST_SHINGLES, SIMILAR = 5, 64, 16, 20, 0.80
# Signatures only choose what is compared: at a similarity of 0.8, fewer values agree once in some 500,000 pairs.
LEAST_AGREE = 36

# Members of a bucket that one task compares with as many others.
BLOCK = 512

# What generators say at the head of a file, in any words: a tag of their own, or where the file comes from together with
# a warning not to edit it.  Copies from elsewhere say so, or carry the licence of their authors.
_TAGGED = re.compile(
    r"@generated\b|<auto-?generated|\b(?:this|code|file|auto(?:matically|-)?)(?: file)? (?:is |was )?(?:auto(?:matically|-)? ?)?generated (?:by|from|with|using|on)\b|\bthis file (?:is|was) (?:auto(?:matically|-)? ?)?generated\b"
    r"|\bauto-?generated (?:file|code)\b|\b(?:automatically|auto|machine)[ -](?:produced|generated|created|written)\b(?=[^\n\w]*(?:$|[.;,!:(]|(?:by|from|with|using|on|file|code)\b))"
    r"|\bre-?(?:generate|build|create) (?:it |this |this file )?(?:with|using|via|by running)\b"
    r"|^\W*generated (?:on|by|from|with|using|automatically)\b|\b(?:fichier|archivo|datei) (?:\w+ )?(?:produit|g[ée]n[ée]r[ée]|generado|producido|erzeugt|generiert)\b|\bautomatisch (?:erzeugt|generiert)\b|\bgenerado autom[áa]ticamente\b", re.I | re.M)
_ORIGIN = re.compile(r"\b(?:(?:re-?)?(?:generated?|built|written|produced|created|compiled|emitted|run|made)|output|template|codegen|[\w-]+-gen|erzeugt|generiert|g[ée]n[ée]r[ée]|produit|generado)\b", re.I)
_WARNED = re.compile(
    r"\b(?:do not|don't|never) (?:edit|modify|change|alter|touch)\b|\b(?:edits?|changes?|modifications?)\b[^.\n]{0,40}\b(?:lost|overwritten|survive|discarded|ignored|undone|reverted)\b"
    r"|\bne pas (?:modifier|[ée]diter)\b|\bnicht (?:von hand |manuell )?(?:bearbeiten|[äa]ndern)\b|\bno (?:editar|modificar)\b", re.I)
_THIRD_PARTY = re.compile(
    r"\b(?:imported|copied|taken|vendored|bundled|synced|mirrored)\b[^.\n]{0,30}\b(?:upstream|verbatim|from the)\b|\bthird[- ]party (?:copy|code|source)\b|^\W*@license\b|\(c\) [^\n]{0,80}\breleased under\b|^\W*vendored from\b", re.I | re.M)
# What compilers to another dialect leave in their output.
_EMITTED = ("__esModule", "/** @class */", "void 0", "(this && this.__")
# Names that tools give to what they write.
GENERATED_NAME = r"(?i)(\.pb\.(go|cc|h)|_pb2(_grpc)?\.py|\.pb-c\.[ch]|\.tab\.[ch]|[._]gen\.\w+|\.generated\.\w+|[.-]min\.(js|mjs|css)|\.bundle\.js|[.-][0-9a-f]{7,}\.m?js|\.snap)$"
VENDOR_PATH = (
    r"(?i)(?:^|/)(?:vendor|third_party|third-party(?:/src)?|thirdparty|extern(?:al)?(?:/libs)?|deps|node_modules|bower_components|_?vendored|pods|3p|contrib/upstream)"
    r"/([a-z0-9]*[a-z])[0-9]*/(?:.*/)?\1")
_NEVER = r"(?i)\.(md|rst|txt|ya?ml|toml|ini|cfg|adoc)$"

_COMMENT = re.compile(r"\s*(?://|/\*|\*|#(?!\s*(?:include|define|ifn?def|if|pragma)\b)|<!--|--|;|\"\"\"|'''|$)")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*(?!\w)")
_WORDS = re.compile(r"\w+")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{40,}|(?:\\x[0-9a-fA-F]{2}){16,}")
_DIGITS = re.compile(r"[0-9]+")
_NO_DIGITS = {ord(d): None for d in "0123456789"}


def head(text: str) -> str:
    """The comment lines with which a file begins."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if not _COMMENT.match(text[at:end]):
            break
        at = end + 1
    return text[:at]


def layout(text: str, words: list[str]) -> dict:
    """Layout statistics of a text whose words are given."""
    n = len(text)
    lines = text.split("\n")
    white = n - sum(map(len, text.split()))
    letters = sum(map(len, words))
    longest = max(map(len, lines))
    # Counting is skipped where it can't reach a threshold: one C-level pass tells the share of digits.
    digits = n - len(text.translate(_NO_DIGITS))
    numbers = sum(map(len, _NUMBER.findall(text))) if digits > 0.2 * n else digits
    runs = sum(map(len, _RUN.findall(text))) if max(map(len, words), default=0) >= 20 or "\\x" in text else 0
    numbered, full = 0, 1
    if digits and len(lines) >= 20:
        masked = [line.strip() for line in _DIGITS.sub("0", text).split("\n")]
        numbered = sum(k for m, k in Counter(masked).items() if k >= 5 and len(m) >= 10 and "0" in m)
        full = sum(len(m) > 2 for m in masked) or 1
    return {
        "n_chars": n, "n_lines": len(lines), "max_line": longest, "mean_line": n / len(lines), "white_share": white / n if n else 0.0,
        "alnum_share": letters / n if n else 0.0, "number_share": numbers / (n - white) if n > white else 0.0, "run_share": runs / n if n else 0.0,
        "numbered_share": numbered / full}


def marks(text: str) -> tuple[bool, bool, bool]:
    """(marked as generated, marked as third-party, written by a compiler to another dialect)."""
    top = head(text)
    return bool(_TAGGED.search(top) or (_WARNED.search(top) and _ORIGIN.search(top))), bool(_THIRD_PARTY.search(top)), sum(sign in text for sign in _EMITTED) >= 3


class Sketch:
    """MinHash over shingles of SHINGLE words."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20_240)
        self.a = (rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32)
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def signature(self, words: list[str]) -> tuple[int, np.ndarray | None]:
        """(hash of the words, the signature or None for texts of too few shingles)."""
        h = self.hashes(words)
        whole = xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)
        if len(h) < SHINGLE + LEAST_SHINGLES:
            return whole, None
        short = self.shingles(h)
        out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 4096):
            np.minimum(out, (short[at : at + 4096, None] * self.a + self.b).min(0), out=out)
        return whole, out

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """The distinct shingles of a text of the words that h are the hashes of, in order."""
        mix = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k]
        return np.unique(((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


_FACTS = (
    "file_id long, repo long, n_chars long, n_lines long, max_line long, mean_line double, white_share double, alnum_share double, number_share double, "
    "run_share double, numbered_share double, n_words long, marked boolean, copied boolean, emitted boolean, content long, signature array<int>")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sketch = Sketch()
    for batch in batches:
        rows = []
        for file_id, repo, text in zip(batch["file_id"], batch["repo"], batch["content"], strict=True):
            words = _WORDS.findall(text)
            content, signature = sketch.signature(words)
            marked, copied, emitted = marks(text)
            rows.append({
                "file_id": file_id, "repo": repo, **layout(text, words), "n_words": len(words), "marked": marked, "copied": copied, "emitted": emitted, "content": content,
                "signature": None if signature is None else signature.view(np.int32).tolist()})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FACTS.split(", ")]).astype({"repo": "Int64"})


def layout_reasons(extension: Column) -> Column:
    """The layout thresholds of the file's language over its statistics, as an array of reasons."""

    def limit(name: str) -> Column:
        known = F.create_map(*[F.lit(x) for ext, l in LAYOUTS.items() for x in (ext, float(getattr(l, name)))])
        return F.coalesce(known[extension], F.lit(float(getattr(DEFAULT, name))))

    tall = F.col("n_chars") >= LEAST_CHARS
    data = tall & ((F.col("run_share") >= limit("runs")) | (F.col("number_share") >= limit("numbers")))
    dense = (F.col("white_share") < limit("white")) & (F.col("alnum_share") >= limit("alnum"))
    minified = tall & ~data & dense & ((F.col("mean_line") > limit("mean_line")) | (F.col("max_line") > limit("max_line")))
    numbered = tall & (F.col("numbered_share") >= limit("numbered_lines")) & (F.col("n_lines") >= 20)
    named = {"marked": F.col("marked"), "copied": F.col("copied"), "data": data, "minified": minified, "emitted": F.col("emitted"), "numbered": numbered}
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]), lambda r: r.isNotNull())


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


_PAIRS = "a long, b long, asked long, more boolean"


_KEY = ["band", "value", "block", "turn"]


def _candidates(low: int, high: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each open row of a block, the members of other repositories at the places low to high by agreement.

    Rows come sorted by block, many blocks in a batch.
    """

    def pairs(rows: pd.DataFrame) -> list[tuple]:
        key = rows[_KEY].to_numpy(np.int64)
        content, first, last, is_open = (rows[c].to_numpy() for c in ("content", "low", "high", "open"))
        signature = np.array(rows["signature"].tolist(), np.int32).reshape(-1, PERMUTATIONS)
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        out = []
        for begin, end in zip(begins, np.append(begins[1:], len(rows)), strict=True):
            here = np.arange(begin, end)
            members = here[~is_open[here]]
            for at in here[is_open[here]]:
                agree = (signature[members] == signature[at]).sum(1)
                apart = ((first[members] != first[at]) | (last[members] != last[at]) | (first[members] != last[members])) & (content[members] != content[at])
                fit = apart & (agree >= LEAST_AGREE)
                others, agree = members[fit], agree[fit]
                best = others[np.lexsort((content[others], -agree))]
                out += [(*sorted((content[at], content[other])), content[at], len(best) > high) for other in best[low:high]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last block of a batch may go on in the next one.
            last = (held[_KEY] == held[_KEY].iloc[-1]).all(axis=1).to_numpy()
            yield pd.DataFrame(pairs(held[~last]) if not last.all() else [], columns=["a", "b", "asked", "more"])
            held = held[last].reset_index(drop=True)
        if held is not None:
            yield pd.DataFrame(pairs(held), columns=["a", "b", "asked", "more"])

    return run


def _blocks(met: DataFrame, still: DataFrame) -> DataFrame:
    """Open members of each bucket against all of its members, in blocks of about BLOCK of either side."""
    opened = met.join(still, "content", "left_semi")
    counts = opened.groupBy("band", "value").agg(F.count("*").alias("o"), F.first("n").alias("n"))
    sized = counts.select("band", "value", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("o") / BLOCK).alias("turns"))
    row = F.xxhash64("content")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    members = met.join(sized, ["band", "value"]).withColumn("block", F.pmod(row, F.col("blocks"))).withColumn("turn", every("turns")).withColumn("open", F.lit(False))
    asked = opened.join(sized, ["band", "value"]).withColumn("turn", F.pmod(row, F.col("turns"))).withColumn("block", every("blocks")).withColumn("open", F.lit(True))
    return members.unionByName(asked)


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sketch = Sketch()
    for batch in batches:
        rows = [sketch.shingles(sketch.hashes(_WORDS.findall(t))).view(np.int32).tolist() for t in batch["content_text"]]
        yield pd.DataFrame({"content": batch["content"], "shingles": rows})


def _leads(met: DataFrame, still: DataFrame) -> DataFrame:
    """(a, b) of each open member with one member of another repository of each of its buckets."""
    one = F.struct("low", "high", "content", "signature")
    ends = met.groupBy("band", "value").agg(F.min(one).alias("first"), F.max(F.struct("high", "low", "content", "signature")).alias("last"))
    lead = lambda c: F.when((F.col("first.low") != F.col("high")) | (F.col("first.high") != F.col("low")), F.col(f"first.{c}")).otherwise(F.col(f"last.{c}"))
    asked = met.join(still, "content", "left_semi").join(ends, ["band", "value"]).select("content", "signature", lead("content").alias("lead"), lead("signature").alias("lead_signature"))
    agree = F.aggregate(F.zip_with("signature", "lead_signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return asked.where((F.col("content") != F.col("lead")) & (agree >= LEAST_AGREE)).select(F.least("content", "lead").alias("a"), F.greatest("content", "lead").alias("b")).distinct()


def spread_copies(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """`content` of texts that stand, equal or nearly so, in more than one repository.

    facts: file_id, content, repo (a number for each repository), n_words, signature; repeated rows change nothing.  texts: file_id, content, the text.  Equal texts are
    grouped first, so that only distinct ones meet in the bands; short ones are compared by their hash alone, and
    those of less than one shingle say nothing.  Members of a bucket are compared by the shingles of their texts, the
    likeliest partner first; those that found no copy go on with the next until none are left.  In buckets of more than
    BLOCK texts all are first compared with one member of another repository, which settles families of copies; what is
    left is compared in blocks, so no task holds a bucket.
    """
    groups = facts.groupBy("content").agg(
        F.min("repo").alias("low"), F.max("repo").alias("high"), F.first("signature", ignorenulls=True).alias("signature"), F.max("n_words").alias("n_words"), F.min("file_id").alias("file_id")).checkpoint()
    equal = groups.where((F.col("low") != F.col("high")) & (F.col("n_words") >= SHINGLE)).select("content")
    size = PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.slice("signature", k * size + 1, size), k))
    members = groups.where(F.col("signature").isNotNull()).select("content", "low", "high", F.posexplode(bands).alias("band", "value"))
    buckets = members.groupBy("band", "value").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("n")).where("n > 1 AND least <> most").select("band", "value", "n")
    met = members.join(buckets, ["band", "value"]).checkpoint()

    def alike(pairs: DataFrame) -> DataFrame:
        """`content` of the texts of pairs whose shingles are alike."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct().join(groups.select("content", "file_id"), "content")
        named = texts.select("file_id", F.col("content").alias("content_text")).join(ids, "file_id").dropDuplicates(["content"])
        sets = named.select("content", "content_text").mapInPandas(_shingled, "content long, shingles array<int>").checkpoint()
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(shared >= F.lit(SIMILAR) * (F.size("sa") + F.size("sb") - shared)).select(F.explode(F.array("a", "b")).alias("content")).distinct().checkpoint()

    # Equal copies need no partner, but are partners of others.
    still = met.select("content").distinct().join(equal, "content", "left_anti").checkpoint()
    signed = met.join(groups.select("content", "signature"), "content")
    large = signed.where(F.col("n") > BLOCK)
    found = equal
    if not large.isEmpty():
        close = alike(_leads(large, still).checkpoint())
        found, still = found.unionByName(close), still.join(close, "content", "left_anti").checkpoint()
    low, high = 0, 1
    while not still.isEmpty():
        blocks = _blocks(signed, still).select(*_KEY, "content", "low", "high", "signature", "open").repartition(*_KEY).sortWithinPartitions(*_KEY)
        pairs = blocks.mapInPandas(_candidates(low, high), _PAIRS).distinct().checkpoint()
        close = alike(pairs.select("a", "b").distinct())
        found = found.unionByName(close)
        still = pairs.where("more").select(F.col("asked").alias("content")).distinct().join(close, "content", "left_anti").checkpoint()
        low, high = high, 16 * high
    return found.distinct()


def not_hand_written(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, reasons): files that a tool wrote or minified, third-party copies, and data saved as code.

    files: file_id, path, indexed_at.  texts: file_id, repo_id, content.  Documentation and configuration never
    count; a file without text is judged by its name alone; null ids and paths are left out; repeated rows
    count once.  reasons: what spoke against the file, in order.
    """
    paths = latest(files, "file_id", ["path"], "indexed_at").where(F.col("path").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), _plain_path(F.col("path")).alias("path"))
    code = paths.where(~F.col("path").rlike(_NEVER))
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    repo = F.when(F.col("repo_id").isNotNull(), F.xxhash64("repo_id"))
    full = texts.where(F.col("file_id").isNotNull() & (F.length("content") > 0)).select(F.col("file_id").cast("long").alias("file_id"), repo.alias("repo"), "content")
    # Texts are read once; only an input of fewer splits than cores is spread first, and candidates' texts are read again.
    facts = spread(full).mapInPandas(_read, _FACTS).checkpoint()
    written = facts.join(code.select("file_id"), "file_id", "left_semi")
    shared = spread_copies(written, full).withColumn("spread", F.lit(True))
    once = facts.drop("signature", "repo", "n_words").dropDuplicates(["file_id"])
    judged = code.join(once, "file_id", "left").withColumn("reasons", layout_reasons(extension)).join(shared, "content", "left")
    named = F.when(F.col("path").rlike(GENERATED_NAME), F.array(F.lit("named"))).otherwise(F.array().cast("array<string>"))
    housed = F.when(F.col("path").rlike(VENDOR_PATH), F.array(F.lit("vendored"))).otherwise(F.array().cast("array<string>"))
    copied = F.when(F.col("spread"), F.array(F.lit("spread"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.coalesce("reasons", F.array().cast("array<string>")), named, housed, copied)
    return judged.select("file_id", every.alias("reasons")).where(F.size("reasons") > 0)


def _found(spark: SparkSession, directory: str) -> DataFrame:
    shared_folder(spark)
    return not_hand_written(table(spark, directory, "files"), table(spark, directory, "file_texts"))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Files to leave out of hand-written source."""
    return _found(spark, directory).select(F.col("file_id").cast("int").alias("file_id"))


def p1_reasons(spark: SparkSession, directory: str) -> DataFrame:
    """The same with the reasons."""
    return _found(spark, directory).select(F.col("file_id").cast("int").alias("file_id"), F.array_join("reasons", ",").alias("reasons"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons}
ORACLES: dict[str, str] = {}
