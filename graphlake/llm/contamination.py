"""Evaluation texts that stand in training documents, found with an FM-index per shard of documents.

Documents are read as words; a shard's words (those of no evaluation text collapsed to one symbol) form one
string, whose Burrows-Wheeler transform is kept in a wavelet matrix.  All phrases of the evaluation texts are
searched backwards together; sampled suffix positions give the places.  Places on one diagonal are chained to
spans, and a span is then checked word by word.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.sources.tables import one_each, table

# Words of a searched phrase, and of a shard.
PHRASE, SHARD_WORDS = 4, 400_000
# Suffix positions kept: one in so many.
SAMPLE = 8
# Share of an item's words that a span must hold; share of a span's phrases peculiar to few items that must agree.
LEAST_SHARE, LEAST_OWN = 0.4, 0.5
# Phrases that more items than this share are common text and don't support a span.
COMMON_ITEMS = 2
# Words that may be left out, put in or changed between two matches of one span.
GAP, DRIFT = 10, 6
# Items searched at once; more go in blocks of this size.
ITEM_BLOCK = 20_000

_TAG = re.compile(r"<[^<>\n]{0,200}>")
_PREFIX = re.compile(r"^[ \t]*(?:\d+[ \t]*[|:.)][ \t]?|\d+[ \t]{2,}|[>|*+#/;%-]+[ \t]?)+", re.M)
_ESCAPE = re.compile(r"\\[nrt\"]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup, line prefixes, punctuation and escapes."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    return _WORD.findall(_PREFIX.sub(" ", text).casefold())


class WaveletMatrix:
    """Ranks over a sequence of symbols: how often a symbol occurs before a position, for many at once."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.ranks = [], []
        s = sequence.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            rank = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(len(s) - int(rank[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        # After the last level, equal symbols lie together; where each begins.
        change = np.flatnonzero(np.diff(s, prepend=-1))
        self.starts = np.zeros(1 << self.bits, np.int64)
        self.starts[s[change]] = change
        self.present = np.zeros(1 << self.bits, bool)
        self.present[s[change]] = True

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        p = position.astype(np.int64)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            ones = self.ranks[k][p]
            p = np.where(bit == 1, self.zeros[k] + ones, p - ones)
        return np.where(self.present[symbol], p - self.starts[symbol], 0)

    def access(self, position: np.ndarray) -> np.ndarray:
        p = position.astype(np.int64)
        out = np.zeros(len(p), np.int64)
        for k in range(self.bits):
            rank = self.ranks[k]
            bit = rank[p + 1] - rank[p]
            out = (out << 1) | bit
            p = np.where(bit == 1, self.zeros[k] + rank[p], p - rank[p])
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence of whole numbers, by doubling; only what is still tied is sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    while True:
        # Groups of equal rank with more than one member are open.
        size = np.diff(np.append(np.flatnonzero(head), n))
        open_heads = np.flatnonzero(head)[size > 1]
        if len(open_heads) == 0:
            return order
        sizes = size[size > 1]
        slots = np.repeat(open_heads, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        members = order[slots]
        nxt = members + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[members]
        by = np.lexsort((second, first))
        members, first, second = members[by], first[by], second[by]
        order[slots] = members
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[slots] = new
        # New ranks: the slot where each subgroup begins.
        rank[members] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        h *= 2


class FMIndex:
    """Backward search over a sequence of symbols 1..sigma-1, with every SAMPLE-th suffix position kept."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        s = np.append(sequence.astype(np.int64), 0)  # 0 ends the string and occurs nowhere else
        order = suffix_array(s)
        bwt = s[order - 1]
        self.n = len(s)
        self.matrix = WaveletMatrix(bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        kept = order % SAMPLE == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept = kept
        self.positions = order[kept]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence of every row of `phrases`."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            start = self.before[symbol]
            low[live], high[live] = start + self.matrix.rank(symbol, low[live]), start + self.matrix.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        count = np.zeros(len(phrases), np.int64)
        count[live] = high[live] - low[live]
        which = np.repeat(np.arange(len(phrases)), count)
        row = np.repeat(low, count) + (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
        steps = np.zeros(len(row), np.int64)
        position = np.full(len(row), -1, np.int64)
        walking = np.arange(len(row))
        while len(walking):
            here = self.kept[row[walking]]
            done = walking[here]
            position[done] = self.positions[self.kept_rank[row[done]]] + steps[done]
            walking = walking[~here]
            symbol = self.matrix.access(row[walking])
            row[walking] = self.before[symbol] + self.matrix.rank(symbol, row[walking])
            steps[walking] += 1
        return which, position


class Items:
    """Evaluation texts: their words as symbols, and all their phrases, each with the items and places it stands in."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = [(i, words(t)) for i, t in rows if i is not None]
        texts = [(i, w) for i, w in texts if w]
        self.ids = [i for i, _ in texts]
        # Symbols: 0 ends, 1 separates documents and stands for words of no item.
        self.symbol = {w: k + 2 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.sigma = len(self.symbol) + 2
        self.sequences = [np.array([self.symbol[w] for w in ws], np.int64) for _, ws in texts]
        places: dict[tuple, list] = defaultdict(list)
        for k, s in enumerate(self.sequences):
            width = min(PHRASE, len(s))
            for j in range(len(s) - width + 1):
                places[tuple(s[j : j + width].tolist())].append((k, j))
        self.by_width = {}
        self.own = [np.zeros(len(s), bool) for s in self.sequences]
        for width in {len(p) for p in places}:
            mine = [(p, v) for p, v in places.items() if len(p) == width]
            self.by_width[width] = (np.array([p for p, _ in mine], np.int64), [v for _, v in mine])
        for v in places.values():
            if len({k for k, _ in v}) <= COMMON_ITEMS:
                for k, j in v:
                    self.own[k][j] = True


def spans(hits: list[tuple[int, int]], own: np.ndarray, length: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """(item first, item last, document first, document last, words matched) of each run of phrase matches.

    hits: (document position, item position) of matching phrases of `width` words.  Matches follow one another
    in both texts, with at most GAP words between and a shift of at most DRIFT.
    """
    chains: list[dict] = []
    live: list[dict] = []
    at = -1
    for d, i in sorted(set(hits)):
        if d != at:
            # Chains that nothing can continue any more leave the search.
            live = [c for c in live if d - c["d"] <= GAP + width]
            at = d
        best = None
        for c in reversed(live):
            step_d, step_i = d - c["d"], i - c["i"]
            if step_d > 0 and 0 < step_i <= GAP + width and abs(step_d - step_i) <= DRIFT and (best is None or c["n"] > best["n"]):
                best = c
        if best is None:
            live.append({"d": d, "i": i, "d0": d, "i0": i, "n": 1, "words": set(range(i, i + width)), "own": int(own[i])})
            chains.append(live[-1])
        else:
            best["d"], best["i"] = d, i
            best["n"] += 1
            best["words"].update(range(i, i + width))
            best["own"] += int(own[i])
    return [(c["i0"], c["i"] + width - 1, c["d0"], c["d"] + width - 1, len(c["words"]), c["own"]) for c in chains]


def _judge(first: int, last: int, own_hits: int, matched: int, own: np.ndarray, length: int) -> bool:
    extent = last - first + 1
    peculiar = int(own[first : last + 1].sum())
    return extent >= LEAST_SHARE * length - 1e-9 and matched >= 0.5 * extent and own_hits >= LEAST_OWN * max(1, peculiar) and own_hits > 0


def search_shard(documents: list[list[str]], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first word, last word, words matched) of every span in the documents of a shard."""
    code = items.symbol
    # Copies of a document are searched once.
    texts: dict[tuple, list[int]] = defaultdict(list)
    for k, ws in enumerate(documents):
        known = tuple(code.get(w, 1) for w in ws)
        if any(v != 1 for v in known):
            texts[known].append(k)
    if not texts:
        return []
    groups = list(texts.items())
    lengths = np.array([len(t) + 1 for t, _ in groups])
    begins = np.cumsum(lengths) - lengths
    whole = np.concatenate([np.array([*t, 1], np.int64) for t, _ in groups])
    # Runs of unknown words cannot match: one symbol each, with the original places kept aside.
    unknown = whole == 1
    keep = ~(unknown & np.concatenate([[False], unknown[:-1]]))
    place = np.flatnonzero(keep)
    index = FMIndex(whole[keep], items.sigma)
    hits: dict[tuple[int, int], list] = defaultdict(list)
    for width, (phrases, where) in items.by_width.items():
        which, at = index.find(phrases)
        at = place[at]
        document = np.searchsorted(begins, at, side="right") - 1
        for p, d, a in zip(which.tolist(), document.tolist(), (at - begins[document]).tolist(), strict=True):
            for k, j in where[p]:
                hits[(d, k, width)].append((a, j))
    out = []
    for (d, k, width), found in hits.items():
        own, length = items.own[k], len(items.sequences[k])
        # Without a phrase peculiar to few items no span counts.
        if not any(own[j] for _, j in found):
            continue
        for i0, i1, d0, d1, matched, own_hits in spans(found, own, length, width):
            if _judge(i0, i1, own_hits, matched, own, length):
                out += [(copy, items.ids[k], d0, d1, matched) for copy in groups[d][1]]
    return out


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, matched_words): items that stand in documents, wholly or in part.

    documents: doc_id, text.  items: item_id, text; a stated set, searched in blocks of ITEM_BLOCK.  A document
    holds an item if one run of it, in order, spans LEAST_SHARE of the item's words, single words changed or
    left out, and the phrases peculiar to the item agree; text shared by many items alone does not count.  One
    row per run: a document that holds an item twice has two.  Null or empty texts hold nothing and are held by nothing;
    rows with null ids are left out; repeated ids count once.
    """
    docs = one_each(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").where(F.length("text") > 0)
    wanted = one_each(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id")
    total = wanted.count()
    blocks = max(1, -(-total // ITEM_BLOCK))
    found = None
    for block in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()]
        part = docs.mapInPandas(_searcher(rows), "doc_id long, item_id long, first_word int, last_word int, matched_words int")
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(rows: list[tuple[int, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(rows)
        ids: list[int] = []
        texts: list[list[str]] = []
        size = 0

        def flush() -> pd.DataFrame:
            found = search_shard(texts, items) if texts and items.ids else []
            out = pd.DataFrame(found, columns=["doc_id", "item_id", "first_word", "last_word", "matched_words"], dtype=np.int64)
            out["doc_id"] = np.array([ids[d] for d in out["doc_id"]], np.int64)
            return out.astype({"first_word": np.int32, "last_word": np.int32, "matched_words": np.int32})

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ws = words(text)
                ids.append(int(doc))
                texts.append(ws)
                size += len(ws)
                if size >= SHARD_WORDS:
                    yield flush()
                    ids, texts, size = [], [], 0
        if texts:
            yield flush()

    return run


def removal_spans(runs: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, items): the words of each document to take out, runs that overlap or touch merged.

    runs: doc_id, item_id, first_word, last_word.  items: the items that the span holds, in order.
    """
    order = Window.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id")
    before = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("first_word") > before + 1), 1).otherwise(0)
    numbered = runs.withColumn("begins", begins).withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "span").agg(
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("span")


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents and the evaluation items that stand in them."""
    return contaminated(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, directory: str) -> DataFrame:
    """The words of each document to take out, and the items that they hold."""
    runs = contaminated(table(spark, directory, "documents"), table(spark, directory, "eval_items"))
    return removal_spans(runs).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans}
ORACLES: dict[str, str] = {}
