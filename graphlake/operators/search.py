"""Lexical, dense and name search over chunks and files, and their fusion; many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions import paths as P
from graphlake.functions import text as X

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Tuning:
    """The weights and limits of hybrid search."""

    cand: int = 200
    k: float = 20.0
    wd: float = 1.0
    wi: float = 1.0
    wt: float = 2.0
    wf: float = 2.0
    k1f: float = 1.5
    lam: float = 0.5
    dec: float = 0.4
    pw: float = 1.5
    mw: float = 1.0
    qcap: int = 48
    symcap: int = 4

    @classmethod
    def read(cls, text: str) -> Tuning:
        """`name=value,name=value`; unknown names and values that are no numbers are passed over."""
        known, out = cls.__dataclass_fields__, {}
        for part in text.split(","):
            name, _, value = part.partition("=")
            try:
                number = float(value)
            except ValueError:
                continue
            if name.strip() in known:
                out[name.strip()] = int(number) if known[name.strip()].type == "int" else number
        return cls(**out)


def postings(units: DataFrame, unit: str, words: str) -> DataFrame:
    """(unit, term, tf): how often each unit holds each word of its array of words."""
    return units.select(unit, F.explode(words).alias("term")).groupBy(unit, "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight): the distinct words of each query (query_id, text), each of weight 1."""
    return queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).withColumn("weight", F.lit(1.0))


def cap_terms(terms: DataFrame, post: DataFrame, n: DataFrame, cap: int) -> DataFrame:
    """The `cap` terms of each query with the largest weight times idf; ties by term.  n: one row with n, the units."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    worth = F.when(F.col("df").isNull(), 0.0).otherwise(F.col("weight") * idf)
    ranked = terms.join(df, "term", "left").crossJoin(F.broadcast(n)).withColumn("worth", worth)
    order = Window.partitionBy("query_id").orderBy(F.desc("worth"), "term")
    return ranked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= cap).select("query_id", "term", "weight")


def bm25(post: DataFrame, lengths: DataFrame, terms: DataFrame, unit: str, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, unit, score, matched): BM25 times (0.5 + share of the query's terms that match).

    post: unit, term, tf.  lengths: unit, len, of the whole corpus: number, average and document frequencies
    always count all units, even if `keep` (unit) leaves only some to be scored.
    """
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = post.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    asked = terms.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    wanted = post if keep is None else post.join(keep, unit, "left_semi")
    hits = wanted.join(asked, "term").join(lengths, unit)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    size = terms.groupBy("query_id").agg(F.count("*").alias("size"))
    scored = hits.groupBy("query_id", unit).agg(F.sum(F.col("weight") * F.col("idf") * norm).alias("s"), F.count("*").alias("matched"))
    return scored.join(size, "query_id").select("query_id", unit, (F.col("s") * (0.5 + F.col("matched") / F.col("size"))).alias("score"), "matched")


def bm25_files(post: DataFrame, chunks: DataFrame, terms: DataFrame, k1: float = 1.5, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, file_id, score): BM25 of whole files from the postings of their chunks.

    chunks: chunk_id, file_id, len.  Here document frequencies count the files left by `keep` (chunk_id).
    """
    sizes = chunks.groupBy("file_id").agg(F.sum("len").alias("len")).where("len > 0")
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = post.join(terms.select("term").distinct(), "term", "left_semi")
    wanted = wanted if keep is None else wanted.join(keep, "chunk_id", "left_semi")
    per_file = wanted.join(chunks.select("chunk_id", "file_id"), "chunk_id").groupBy("file_id", "term").agg(F.sum("tf").alias("tf"))
    df = per_file.groupBy("term").agg(F.count("*").alias("df"))
    asked = terms.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return per_file.join(asked, "term").join(sizes, "file_id").groupBy("query_id", "file_id").agg(F.sum(F.col("weight") * F.col("idf") * norm).alias("score"))


def top(scored: DataFrame, unit: str, k: int) -> DataFrame:
    """`scored` with `at`, the place of each row from 0, the first k of each query; ties by unit."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), unit)
    return scored.withColumn("at", F.row_number().over(order) - 1).where(F.col("at") < k)


# Query vectors that one pass over all rows takes; more go in several passes.
DENSE_BLOCK = 1_000


def _nearest(batches: Iterator[pd.DataFrame], unit: str, queries: dict, k: int) -> Iterator[pd.DataFrame]:
    """The k best rows of the batches for each query.  queries: by length of the vectors, (ids, vectors, norms)."""
    for batch in batches:
        sizes = batch["vec"].map(len).to_numpy()
        for size, (ids, asked, asked_norms) in queries.items():
            mine = batch[sizes == size]
            if mine.empty:
                continue
            units, norms = mine[unit].to_numpy(), mine["norm"].to_numpy()
            vectors = np.array(mine["vec"].tolist(), np.float64)
            near = (asked @ vectors.T) / (asked_norms[:, None] * norms)
            least = np.partition(near, -k, axis=1)[:, -k] if len(units) > k else np.full(len(ids), -np.inf)
            # Products of matrices differ in the last digits; what may be among the best is added up in order.
            q, v = np.nonzero(near >= least[:, None] - 1e-9)
            dots = np.concatenate([np.add.accumulate(asked[q[at : at + 10_000]] * vectors[v[at : at + 10_000]], axis=1)[:, -1] for at in range(0, len(q), 10_000)])
            found = pd.DataFrame({"query_id": ids[q], unit: units[v], "score": dots / (norms[v] * asked_norms[q])})
            yield found.sort_values(["query_id", "score", unit], ascending=[True, False, True]).groupby("query_id").head(k)


def dense(vectors: DataFrame, queries: DataFrame, unit: str, k: int) -> DataFrame:
    """(query_id, unit, score, at): the k rows with the highest cosine for each query vector; ties by unit.

    vectors: unit, vec.  queries: query_id, vec, any number; one pass takes DENSE_BLOCK of them.  Null, zero and
    differently long vectors match nothing.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    asked = queries.where(F.col("vec").isNotNull()).select("query_id", "vec", norm.alias("norm")).where("norm > 0").checkpoint()
    rows = vectors.where(F.col("vec").isNotNull()).select(unit, "vec", norm.alias("norm")).where("norm > 0")
    blocks = max(1, -(-asked.count() // DENSE_BLOCK))
    rows = rows.checkpoint() if blocks > 1 else rows
    kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema, *rows.schema)}
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        sizes = part["vec"].map(len)
        by_size = {
            int(n): (g["query_id"].to_numpy(), np.array(g["vec"].tolist(), np.float64), g["norm"].to_numpy()) for n, g in part.groupby(sizes)}
        met = rows.mapInPandas(lambda batches, by_size=by_size: _nearest(batches, unit, by_size, k), f"query_id {kinds['query_id']}, {unit} {kinds[unit]}, score double")
        scored = top(met, unit, k)
        out = scored if out is None else out.unionByName(scored)
    return out


# Letters of the pieces of names by which parts of names are looked up.
_GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct pieces of n letters of a text; none of a shorter one."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _name_candidates(names: DataFrame, q: DataFrame) -> DataFrame:
    """`names` with the queries that they may match: equal names, a common piece of letters, or two common words."""
    keys = lambda *parts: F.explode(F.array_distinct(F.flatten(F.array(*parts))))
    tagged = lambda tag, array: F.transform(array, lambda v: F.concat(F.lit(tag), v))
    nothing = F.array().cast("array<string>")
    qualified = F.when(F.col("qualified").isNotNull(), F.array("qualified")).otherwise(nothing)
    named = names.withColumn("key", keys(F.array(F.concat(F.lit("="), "nl")), tagged(".", qualified), tagged("~", _grams(F.col("nl"), _GRAM)), tagged(" ", F.col("nt"))))
    part = F.when(F.col("single") & (F.length("ql") >= _GRAM), F.array(F.substring("ql", 1, _GRAM))).otherwise(nothing)
    words = F.when(F.size("qt") > 1, F.col("qt")).otherwise(nothing)
    asked = q.withColumn("key", keys(F.array(F.concat(F.lit("="), "ql")), tagged(".", F.array("ql")), tagged("~", part), tagged(" ", words)))
    return named.join(asked, "key").drop("key").distinct()


def name_scores(symbols: DataFrame, queries: DataFrame, ranks: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, symbol_id, score, at): symbols by name.

    3 for the whole (or qualified) name, 2 for its beginning (one word of 3 letters or more), 1.5 for a part of
    it (4 or more), else, for several words of which two or more are in the name, their share; plus half the rank.
    Names are scored once, however many symbols share them.
    """
    q = queries.select("query_id", F.lower(F.trim("text")).alias("ql"), X.tokens(F.trim("text")).alias("qt"), (~F.trim("text").rlike(r"\s")).alias("single"))
    names = symbols.select("name", F.when(F.col("owner").isNotNull(), F.lower(F.concat_ws(".", "owner", "name"))).alias("qualified")).distinct()
    met = _name_candidates(names.withColumn("nl", F.lower("name")).withColumn("nt", X.tokens(F.col("name"))), q)
    hits = F.size(F.filter("qt", lambda t: F.array_contains(F.col("nt"), t)))
    score = (
        F.when((F.col("nl") == F.col("ql")) | (F.col("ql").contains(".") & (F.col("qualified") == F.col("ql"))), 3.0)
        .when(F.col("single") & (F.length("ql") >= 3) & F.col("nl").startswith(F.col("ql")), 2.0).when(F.col("single") & (F.length("ql") >= 4) & F.col("nl").contains(F.col("ql")), 1.5)
        .when((F.size("qt") > 1) & (hits >= 2), hits / F.size("qt")).otherwise(0.0))
    good = met.withColumn("base", score).where("base > 0").select("query_id", "name", "qualified", "base")
    keyed = symbols.select("symbol_id", "name", F.when(F.col("owner").isNotNull(), F.lower(F.concat_ws(".", "owner", "name"))).alias("qualified"))
    found = good.join(keyed, good["name"].eqNullSafe(keyed["name"]) & good["qualified"].eqNullSafe(keyed["qualified"])).select("query_id", "symbol_id", "base")
    ranked = found.join(ranks, "symbol_id", "left").select("query_id", "symbol_id", (F.col("base") + F.coalesce("rank", F.lit(0.0)) * 0.5).alias("score"))
    return top(ranked, "symbol_id", k)


def identifier_scores(symbols: DataFrame, queries: DataFrame, ranks: DataFrame, symcap: int = 4, k: int = 200) -> DataFrame:
    """(query_id, symbol_id, score, at): symbols named exactly by an identifier of the query; names of more than symcap symbols don't count."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(F.transform(X.code_words(F.col("text")), F.lower))).alias("low"))
    counts = symbols.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("c")).where(F.col("c") <= symcap)
    met = wanted.join(counts, "low").join(symbols.select("symbol_id", F.lower("name").alias("low")), "low").join(ranks, "symbol_id", "left")
    scored = met.groupBy("query_id", "symbol_id").agg(F.max(1.0 / F.col("c") + F.coalesce("rank", F.lit(0.0)) * 0.5).alias("score"))
    return top(scored, "symbol_id", k)


def fuse(lists: list[tuple[DataFrame, float]], key: list[str], k: float = 20.0) -> DataFrame:
    """(query_id, key..., score): the sum over the lists of weight / (k + place); a list may have its own weight column."""
    parts = [df.select("query_id", *key, ((F.col("weight") if "weight" in df.columns else F.lit(w)) / (k + F.col("at"))).alias("s")) for df, w in lists]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("query_id", *key).agg(F.sum("s").alias("score"))


def rerank(fused: DataFrame, files: DataFrame, queries: DataFrame, file_rank: DataFrame, file_places: DataFrame, t: Tuning, limit: int) -> DataFrame:
    """(query_id, file_id, start_line, score, at): fused chunks regrouped by file and lifted or lowered by what the file is.

    A file's score: its best chunk, plus lam times the decayed sum of the next eight, plus shares of the best
    score of all for words of the query in its path and for being named, plus wf / (k + its place by whole-file
    BM25); times the path penalty and 1 + 0.15 of its rank.  Its first six chunks get the file's score by their
    share of its best, and dec to the power of their place.
    """
    best = fused.groupBy("query_id").agg(F.max("score").alias("max"))
    order = Window.partitionBy("query_id", "file_id").orderBy(F.desc("score"), "start_line")
    placed = fused.withColumn("i", F.row_number().over(order) - 1)
    tail = F.sum(F.when(F.col("i").between(1, 8), F.col("score") * F.pow(F.lit(0.5), F.col("i").cast("double"))).otherwise(0.0))
    per_file = placed.groupBy("query_id", "file_id").agg(F.max("score").alias("s0"), tail.alias("rest"))
    asked = queries.select("query_id", "text", X.query_words(F.col("text")).alias("words"), X.looks_like_symbol(F.trim("text")).alias("symbolish"), X.mentions(F.col("text")).alias("paths"))
    met = per_file.join(asked, "query_id").join(best, "query_id").join(files, "file_id").join(file_rank, "file_id", "left").join(file_places.select("query_id", "file_id", F.col("at").alias("place")), ["query_id", "file_id"], "left")
    lifted = F.when((F.size("words") > 0) & ~F.col("symbolish"), F.col("max") * t.pw * P.path_match(F.col("path"), F.col("words"))).otherwise(0.0)
    named = F.col("max") * t.mw * F.coalesce(F.array_max(F.transform("paths", lambda m: P.path_mention(F.col("path"), m))), F.lit(0.0))
    whole = F.when(F.col("place").isNotNull(), t.wf / (t.k + F.col("place"))).otherwise(0.0)
    score = (F.col("s0") + t.lam * F.col("rest") + lifted + named + whole) * P.path_penalty(F.col("path"), F.col("role"), F.col("lang")) * (1 + 0.15 * F.coalesce("rank", F.lit(0.0)))
    scored = met.select("query_id", "file_id", "s0", score.alias("fs"))
    share = F.when((F.col("i") == 0) | (F.col("s0") <= 0), 1.0).otherwise(F.col("score") / F.col("s0"))
    final = placed.where("i < 6").join(scored, ["query_id", "file_id"]).select("query_id", "file_id", "start_line", (F.col("fs") * share * F.pow(F.lit(t.dec), F.col("i").cast("double"))).alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id", "start_line")
    return final.withColumn("at", F.row_number().over(last) - 1).where(F.col("at") < limit)


def joining(fused: DataFrame, places: DataFrame, chunks: DataFrame, first: int = 30) -> DataFrame:
    """`fused` and, with score 0, the longest chunk of the best files by whole-file BM25 that have none; of equally long ones the last."""
    absent = places.where(F.col("at") < first).select("query_id", "file_id").join(fused, ["query_id", "file_id"], "left_anti")
    longest = chunks.groupBy("file_id").agg(F.max(F.struct("len", "start_line")).alias("c")).select("file_id", F.col("c.start_line").alias("start_line"))
    return fused.unionByName(absent.join(longest, "file_id").select("query_id", "file_id", "start_line", F.lit(0.0).alias("score")))


def snippets(spans: DataFrame, texts: DataFrame, words: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, file_id, start_line, line, text): of each span its first line with text and the lines that hold most
    query words, filled up with the next ones, at most n, in order.  words: query_id, words."""
    body = spans.join(texts, "file_id").join(words, "query_id")
    lines = body.select("query_id", "file_id", "start_line", "words", F.posexplode(X.line_range(F.col("content"), F.col("start_line"), F.col("end_line"))).alias("i", "text"))
    full = lines.where(F.trim("text") != "")
    hits = F.size(F.filter(X.tokens(F.col("text")), lambda w: F.array_contains(F.col("words"), w)))
    span = Window.partitionBy("query_id", "file_id", "start_line")
    ranked = full.withColumn("hits", hits).withColumn("first", F.min("i").over(span))
    order = F.when(F.col("i") == F.col("first"), 0).when(F.col("hits") > 0, 1).otherwise(2)
    picked = ranked.withColumn("at", F.row_number().over(span.orderBy(order, F.desc("hits"), "i"))).where(F.col("at") <= n)
    return picked.select("query_id", "file_id", "start_line", (F.col("start_line") + F.col("i")).alias("line"), X.truncate(F.rtrim("text"), 160).alias("text"))


def popup_match(symbols: DataFrame, queries: DataFrame, callers: DataFrame, ranks: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, symbol_id, score, at): symbols as one types: 100 the name, 60 its beginning, 30 less a tenth of the place in
    it; plus callers, at most 20, plus ten times the rank."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("ql")).where("ql <> ''")
    # Names meet queries over the first letters of the query, as many as it has up to _GRAM.
    names = symbols.where("name IS NOT NULL").select(F.lower("name").alias("nl")).distinct()
    named = names.select("nl", F.explode(F.flatten(F.array(*[_grams(F.col("nl"), n) for n in range(1, _GRAM + 1)]))).alias("key"))
    found = named.join(q.withColumn("key", F.substring("ql", 1, _GRAM)), "key").withColumn("pos", F.instr("nl", F.col("ql")) - 1).where("pos >= 0").drop("key")
    met = symbols.select("symbol_id", F.lower("name").alias("nl")).join(found, "nl")
    base = F.when(F.col("nl") == F.col("ql"), 100.0).when(F.col("pos") == 0, 60.0).otherwise(30.0 - F.col("pos") * 0.1)
    full = met.join(callers, "symbol_id", "left").join(ranks, "symbol_id", "left")
    return top(full.select("query_id", "symbol_id", (base + F.least(F.lit(20), F.coalesce("callers", F.lit(0))) + 10 * F.coalesce("rank", F.lit(0.0))).alias("score")), "symbol_id", k)
