"""Search queries over documents, chunks, symbols and vectors, and grouped selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import text as X
from graphlake.operators import metrics as M
from graphlake.operators import search as Q
from graphlake.operators import windows as W
from graphlake.plans import graphs
from graphlake.plans import sql as S
from graphlake.plans.session import kept_index, shared_folder
from graphlake.sources import facts
from graphlake.sources.tables import one_each, table

QUESTIONS = {
    1: "how is the stale cache rebuilt after the session is closed",
    2: "which callers of the resolver are missing from the graph",
    3: "parseShard",
    4: "memory peaks while the tracker holds both the record and the tunnel in bridge/vault.py",
    5: "Datei mehrfach geöffnet ohne Meldung",
}


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in QUESTIONS.items()], "query_id int, text string")


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return one_each(table(spark, directory, "documents").where("text IS NOT NULL"), "doc_id")


def _document_index(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the documents, written by the first query of the application that needs them."""

    def build() -> tuple[DataFrame, DataFrame]:
        words = _documents(spark, directory).select("doc_id", X.tokens(F.col("text")).alias("ws")).checkpoint()
        return Q.postings(words, "doc_id", "ws").checkpoint(), words.select("doc_id", F.size("ws").alias("len"))

    return kept_index(spark, directory, "documents", build)


def bm25_topk(spark: SparkSession, directory: str) -> DataFrame:
    """The ten best documents for each question."""
    post, lengths = _document_index(spark, directory)
    scored = Q.bm25(post, lengths, Q.query_terms(_questions(spark)), "doc_id")
    return Q.top(scored.withColumn("score", F.round("score", 6)), "doc_id", 10)


def bm25_filtered_stats(spark: SparkSession, directory: str) -> DataFrame:
    """The same among issues only, with the statistics of all documents."""
    post, lengths = _document_index(spark, directory)
    keep = table(spark, directory, "documents").where("source = 'issues'").select("doc_id").distinct()
    scored = Q.bm25(post, lengths, Q.query_terms(_questions(spark)), "doc_id", keep)
    return Q.top(scored.withColumn("score", F.round("score", 6)), "doc_id", 10)


def term_cap(spark: SparkSession, directory: str) -> DataFrame:
    """The eight words of each evaluation text that say most."""
    post, lengths = _document_index(spark, directory)
    items = one_each(table(spark, directory, "eval_items"), "item_id").select(F.col("item_id").alias("query_id"), "text")
    return Q.cap_terms(Q.query_terms(items), post, lengths.agg(F.count("*").alias("n")), 8).select("query_id", "term")


def bm25_batch(spark: SparkSession, directory: str) -> DataFrame:
    """The five best documents for every evaluation text, by its eight best words."""
    post, lengths = _document_index(spark, directory)
    items = one_each(table(spark, directory, "eval_items"), "item_id").select(F.col("item_id").alias("query_id"), "text")
    terms = Q.cap_terms(Q.query_terms(items), post, lengths.agg(F.count("*").alias("n")), 8)
    scored = Q.bm25(post, lengths, terms, "doc_id")
    return Q.top(scored.withColumn("score", F.round("score", 6)), "doc_id", 5)


def _chunk_index(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of chunks: the words of their lines, of their symbol's name twice, and of their path once."""
    return kept_index(spark, directory, "chunks", lambda: _read_chunks(spark, directory))


def _read_chunks(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    files, texts = facts.files(spark, directory), facts.texts(spark, directory)
    chunks = facts.chunks(spark, directory).where("end_line >= start_line AND start_line >= 1")
    named = facts.symbols(spark, directory).select("symbol_id", "name")
    full = chunks.join(files.select("file_id", "path"), "file_id").join(texts, "file_id").join(named, "symbol_id", "left")
    body = X.tokens(F.array_join(X.line_range(F.col("content"), F.col("start_line"), F.col("end_line")), "\n"))
    name = F.coalesce(X.tokens(F.col("name")), F.array().cast("array<string>"))
    words = full.select("chunk_id", "file_id", "start_line", "end_line", "symbol_id", F.concat(body, name, name, X.tokens(F.col("path"))).alias("ws")).checkpoint()
    return Q.postings(words, "chunk_id", "ws").checkpoint(), words.select("chunk_id", "file_id", "start_line", "end_line", "symbol_id", F.size("ws").alias("len"))


def bm25_two_level(spark: SparkSession, directory: str) -> DataFrame:
    """The ten best files for each question, from the postings of their chunks."""
    post, chunks = _chunk_index(spark, directory)
    scored = Q.bm25_files(post, chunks, Q.query_terms(_questions(spark)))
    return Q.top(scored.withColumn("score", F.round("score", 6)), "file_id", 10)


def bm25_chunks(spark: SparkSession, directory: str) -> DataFrame:
    post, chunks = _chunk_index(spark, directory)
    scored = Q.bm25(post, chunks.select("chunk_id", "len"), Q.query_terms(_questions(spark)), "chunk_id")
    return Q.top(scored.withColumn("score", F.round("score", 6)), "chunk_id", 10)


def _vectors(spark: SparkSession, directory: str) -> DataFrame:
    return facts.chunks(spark, directory).where("vec_q IS NOT NULL AND vec_s > 0").select("chunk_id", "repo_id", F.col("vec_q").alias("vec"))


def dense_topk(spark: SparkSession, directory: str) -> DataFrame:
    """The ten most similar chunks for the first vector of each repository."""
    shared_folder(spark)
    vectors = _vectors(spark, directory).where(F.size("vec") == 128)
    queries = vectors.groupBy("repo_id").agg(F.min_by("vec", "chunk_id").alias("vec"), F.min("chunk_id").alias("query_id"))
    found = Q.dense(vectors, queries.select("query_id", "vec"), "chunk_id", 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def embedding_topk(spark: SparkSession, directory: str) -> DataFrame:
    """The five most similar vectors of the embeddings table for the first of each label."""
    shared_folder(spark)
    vectors = one_each(table(spark, directory, "embeddings"), "vec_id").select("vec_id", "label", F.col("embedding").alias("vec"))
    queries = vectors.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"), F.min("vec_id").alias("query_id"))
    return Q.dense(vectors, queries.select("query_id", "vec"), "vec_id", 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def dense_topk_batch(spark: SparkSession, directory: str) -> DataFrame:
    """The ten most similar chunks for every fiftieth chunk with a vector."""
    shared_folder(spark)
    vectors = _vectors(spark, directory).where(F.size("vec") == 128).select("chunk_id", "vec")
    queries = vectors.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return Q.dense(vectors, queries, "chunk_id", 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def embedding_topk_batch(spark: SparkSession, directory: str) -> DataFrame:
    """The five most similar vectors for every fiftieth of the embeddings table."""
    shared_folder(spark)
    vectors = one_each(table(spark, directory, "embeddings"), "vec_id").select("vec_id", F.col("embedding").alias("vec"))
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return Q.dense(vectors, queries, "vec_id", 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "parseShard"), (2, "parse"), (3, "shard"), (4, "load shard parcel"), (5, "TicketSchema.parse")], "query_id int, text string")


def _no_rank(symbols: DataFrame) -> DataFrame:
    return symbols.select("symbol_id", F.lit(0.0).alias("rank"))


def name_match(spark: SparkSession, directory: str) -> DataFrame:
    symbols = facts.symbols(spark, directory)
    return Q.name_scores(symbols, _names(spark), _no_rank(symbols)).select("query_id", "symbol_id", F.round("score", 6).alias("score"), "at")


def ident_unique_names(spark: SparkSession, directory: str) -> DataFrame:
    """Symbols that documents name exactly, if few share the name."""
    symbols = facts.symbols(spark, directory)
    documents = _documents(spark, directory).select(F.col("doc_id").alias("query_id"), "text")
    return Q.identifier_scores(symbols, documents, _no_rank(symbols)).select("query_id", "symbol_id", F.round("score", 6).alias("score"), "at")


def popup_match(spark: SparkSession, directory: str) -> DataFrame:
    symbols = facts.symbols(spark, directory)
    callers = facts.calls(spark, directory).groupBy(F.col("from_symbol").alias("symbol_id")).agg(F.count("*").alias("callers"))
    return Q.popup_match(symbols, _names(spark), callers, _no_rank(symbols)).select("query_id", "symbol_id", F.round("score", 6).alias("score"), "at")


def _lists(spark: SparkSession, directory: str, t: Q.Tuning) -> tuple[list, DataFrame, DataFrame, DataFrame]:
    index = graphs.index(spark, directory)
    post, chunks = _chunk_index(spark, directory)
    questions = _questions(spark)
    terms = Q.cap_terms(Q.query_terms(questions), post, chunks.agg(F.count("*").alias("n")), t.qcap)
    lexical = Q.top(Q.bm25(post, chunks.select("chunk_id", "len"), terms, "chunk_id"), "chunk_id", t.cand).join(chunks.select("chunk_id", "file_id", "start_line"), "chunk_id")
    ranks, symbols = index.symbol_rank(), index.symbols
    placed = symbols.select("symbol_id", "file_id", "start_line")
    by_name = Q.name_scores(symbols, questions, ranks).join(placed, "symbol_id").withColumn("weight", F.when(F.col("score") >= 3.0, 2.0).otherwise(1.0))
    by_ident = Q.identifier_scores(symbols, questions, ranks, t.symcap, t.cand).join(placed, "symbol_id")
    vectors = _vectors(spark, directory).where(F.size("vec") == 128)
    first = vectors.orderBy("chunk_id").limit(1).select(F.explode(F.array(*[F.lit(k) for k in QUESTIONS])).alias("query_id"), "vec")
    by_vector = Q.dense(vectors, first, "chunk_id", t.cand).join(chunks.select("chunk_id", "file_id", "start_line"), "chunk_id")
    files = Q.top(Q.bm25_files(post, chunks, terms, t.k1f), "file_id", 100)
    return [(lexical, 1.0), (by_name, 1.0), (by_ident, t.wi), (by_vector, t.wd)], files, chunks, questions


def rrf_fusion(spark: SparkSession, directory: str) -> DataFrame:
    """The twenty best places for each question from lexical, name, identifier and vector lists together."""
    t = Q.Tuning()
    lists, *_ = _lists(spark, directory, t)
    fused = Q.fuse(lists, ["file_id", "start_line"], t.k).withColumn("score", F.round("score", 6)).withColumn("place", F.col("file_id") * F.lit(10_000_000).cast("long") + F.col("start_line"))
    return Q.top(fused, "place", 20).select("query_id", "file_id", "start_line", "score", "at")


def _hybrid(spark: SparkSession, directory: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = Q.Tuning()
    index = graphs.index(spark, directory)
    lists, places, chunks, questions = _lists(spark, directory, t)
    fused = Q.joining(Q.fuse(lists, ["file_id", "start_line"], t.k), places, chunks)
    rank = index.file_rank().select(F.col("node").alias("file_id"), "rank")
    return Q.rerank(fused, index.files, questions, rank, places, t, limit), chunks, questions


def hybrid_search(spark: SparkSession, directory: str) -> DataFrame:
    """Search as users see it: fused lists, files lifted and lowered, ten hits for each question."""
    return _hybrid(spark, directory, 10)[0].select("query_id", "file_id", "start_line", F.round("score", 3).alias("score"), "at")


def search_snippets(spark: SparkSession, directory: str) -> DataFrame:
    """Three lines of each of the five best hits."""
    hits, chunks, questions = _hybrid(spark, directory, 5)
    ends = chunks.groupBy("file_id", "start_line").agg(F.max("end_line").alias("end_line"))
    spans = hits.join(ends, ["file_id", "start_line"])
    words = questions.select("query_id", X.tokens(F.col("text")).alias("words"))
    return Q.snippets(spans.select("query_id", "file_id", "start_line", "end_line"), facts.texts(spark, directory), words).select("query_id", "file_id", "start_line", "line", "text")


def snippet_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Three telling lines of every chunk with a symbol, for the first question."""
    spans = facts.chunks(spark, directory).where("end_line >= start_line AND symbol_id IS NOT NULL").select(F.lit(1).alias("query_id"), "file_id", "start_line", "end_line").distinct()
    spans = spans.groupBy("query_id", "file_id", "start_line").agg(F.max("end_line").alias("end_line"))
    words = _questions(spark).where("query_id = 1").select("query_id", X.tokens(F.col("text")).alias("words"))
    return Q.snippets(spans, facts.texts(spark, directory), words).select("file_id", "start_line", "line", "text")


def workspace_search(spark: SparkSession, directory: str) -> DataFrame:
    """Each repository searched by itself for the first question, its documents then merged: ten in all."""
    words = _documents(spark, directory).where("repo_id IS NOT NULL").select("doc_id", "repo_id", X.tokens(F.col("text")).alias("ws"))
    stats = words.groupBy("repo_id").agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("avg_len"))
    post = words.select("repo_id", "doc_id", F.size("ws").alias("len"), F.explode("ws").alias("term")).groupBy("repo_id", "doc_id", "len", "term").agg(F.count("*").alias("tf"))
    terms = Q.query_terms(_questions(spark).where("query_id = 1"))
    hits = post.join(terms, "term")
    df = hits.groupBy("repo_id", "term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    scored = hits.join(df, ["repo_id", "term"]).join(stats, "repo_id").groupBy("query_id", "repo_id", "doc_id").agg(F.sum(idf * norm).alias("s"), F.count("*").alias("m"))
    size = terms.groupBy("query_id").agg(F.count("*").alias("size"))
    done = scored.join(size, "query_id").select("query_id", "repo_id", "doc_id", F.round(F.col("s") * (0.5 + F.col("m") / F.col("size")), 6).alias("score"))
    return Q.top(done, "doc_id", 10).select("repo_id", "doc_id", "score")


def line_windows(spark: SparkSession, directory: str) -> DataFrame:
    return W.line_windows(facts.texts(spark, directory))


def per_group_topk(spark: SparkSession, directory: str) -> DataFrame:
    """The five longest symbols of each file, in line order."""
    symbols = facts.symbols(spark, directory).withColumn("span", F.col("end_line") - F.col("start_line"))
    return W.top_per_group(symbols, ["file_id"], [F.desc("span"), F.asc("symbol_id")], 5).select("file_id", "symbol_id", "span")


def outline(spark: SparkSession, directory: str) -> DataFrame:
    """At most thirty symbols of each file, in line order."""
    return W.top_per_group(facts.symbols(spark, directory), ["file_id"], [F.asc("start_line"), F.asc("symbol_id")], 30).select("file_id", "name", "kind", "start_line", "signature")


def entry_points(spark: SparkSession, directory: str) -> DataFrame:
    """Files that a program starts from: by their name, high in the tree, no tests; eight a repository."""
    files = facts.files(spark, directory)
    stem, depth = F.regexp_extract("path", r"([^/.]*)[^/]*$", 1), F.size(F.split("path", "/")) - 1
    names = ("main", "index", "app", "server", "cli", "mod", "lib", "router", "session", "__main__")
    fit = files.where(F.col("lang").isNotNull() & ~F.col("is_test") & stem.isin(*names) & (depth <= 3))
    return W.top_per_group(fit, ["repo_id"], [F.asc("file_id")], 8).select("repo_id", "file_id", "path")


def consecutive_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Calls of a file in line order, repeated names in a row left out."""
    calls = facts.calls(spark, directory).where("file_id IS NOT NULL")
    return W.consecutive_distinct(calls, ["file_id"], [F.asc("line"), F.asc("call_id")], ["name"]).select("call_id", "file_id", "name")


def token_budget(spark: SparkSession, directory: str) -> DataFrame:
    """The first documents of each source that fit 20,000 estimated tokens."""
    documents = _documents(spark, directory).select("doc_id", "source", X.estimate_tokens(F.col("text")).alias("n_tokens"))
    return W.within_budget(documents, ["source"], [F.asc("doc_id")], F.col("n_tokens"), 20_000)


def language_histogram(spark: SparkSession, directory: str) -> DataFrame:
    return facts.files(spark, directory).where("lang IS NOT NULL").groupBy("repo_id", "lang").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))


def distinct_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Per repository: distinct called names, files with calls, and repositories' callers."""
    return facts.calls(spark, directory).groupBy("repo_id").agg(F.countDistinct("name").alias("names"), F.countDistinct("file_id").alias("files"), F.count("*").alias("calls"))


def percentile_index(spark: SparkSession, directory: str) -> DataFrame:
    """p50 and p95 of event values."""
    events = table(spark, directory, "events")
    return W.percentile_by_index(events, "value", 0.5).withColumn("q", F.lit(50)).unionByName(W.percentile_by_index(events, "value", 0.95).withColumn("q", F.lit(95)))


def weighted_quality(spark: SparkSession, directory: str) -> DataFrame:
    """Line-weighted quality of each repository's languages."""
    table_ = F.create_map(*[F.lit(x) for k, v in {"TypeScript": 0.75, "JavaScript": 0.2, "Python": 0.4, "Ruby": 0.2, "Php": 0.5}.items() for x in (k, v)])
    files = facts.files(spark, directory).where("lang IS NOT NULL AND lines > 0").withColumn("q", F.coalesce(F.try_element_at(table_, F.col("lang")), F.lit(1.0)))
    return M.weighted_mean(files, ["repo_id"], "q", "lines").select("repo_id", F.round("mean", 6).alias("quality"))


def _gold(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that hold the first ten words of an evaluation text, as words."""
    items = one_each(table(spark, directory, "eval_items"), "item_id").select(F.col("item_id").alias("query_id"), F.slice(X.tokens(F.col("text")), 1, 10).alias("lead")).where(F.size("lead") > 0)
    # Leads of each length that there is meet the documents' runs of that length.
    lengths = items.select(F.size("lead").alias("n")).distinct()
    words = _documents(spark, directory).select(F.col("doc_id").alias("item"), X.tokens(F.col("text")).alias("ws")).join(F.broadcast(lengths), F.size("ws") >= F.col("n"))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1)
    runs = words.select("item", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("ws", i, F.col("n")), " ")))).alias("run"))
    return runs.join(items.select("query_id", F.array_join("lead", " ").alias("run")), "run").select("query_id", "item").distinct()


def ndcg10(spark: SparkSession, directory: str) -> DataFrame:
    """How well the batch search finds the documents that hold an evaluation text's beginning."""
    ranked = bm25_batch(spark, directory).select("query_id", F.col("doc_id").alias("item"), "at")
    return M.ndcg(ranked, _gold(spark, directory)).select("query_id", "n_relevant", F.round("ndcg", 6).alias("ndcg"))


def acc_at_k(spark: SparkSession, directory: str) -> DataFrame:
    ranked = bm25_batch(spark, directory).select("query_id", F.col("doc_id").alias("item"), "at")
    return M.accuracy(ranked, _gold(spark, directory), (1, 5))


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_filtered_stats, term_cap, bm25_batch, bm25_two_level, bm25_chunks, dense_topk, embedding_topk, dense_topk_batch, embedding_topk_batch, name_match, ident_unique_names, popup_match, rrf_fusion, hybrid_search, search_snippets,
    snippet_lines, workspace_search, line_windows, per_group_topk, outline, entry_points, consecutive_dedup, token_budget, language_histogram, distinct_counts, percentile_index, weighted_quality, ndcg10, acc_at_k)}

_VALUES = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in QUESTIONS.items()) + ") AS q(query_id, text)"
_NAMES = "(VALUES (1, 'parseShard'), (2, 'parse'), (3, 'shard'), (4, 'load shard parcel'), (5, 'TicketSchema.parse')) AS q(query_id, text)"
_POST = f"""docs AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS source, any_value(repo_id) AS repo_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
bag AS (SELECT doc_id, source, repo_id, {S.tokens('text')} AS ws FROM docs), lens AS (SELECT doc_id, source, repo_id, len(ws) AS len FROM bag),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM bag) GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def _terms(source: str, key: str = "query_id") -> str:
    return f"terms AS (SELECT query_id, term, 1.0::DOUBLE AS weight FROM (SELECT {key} AS query_id, unnest(list_distinct({S.tokens('text')})) AS term FROM {source}))"


_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
_SCORE = f"""size AS (SELECT query_id, count(*) AS size FROM terms GROUP BY query_id), scored AS (SELECT query_id, doc_id, source, sum(weight * {_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s, count(*) AS matched
FROM post JOIN terms USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stats GROUP BY query_id, doc_id, source), ranked AS (SELECT query_id, doc_id, source, round(s * (0.5 + matched / size), 6) AS score, matched FROM scored JOIN size USING (query_id))"""
_CAP = f"""capped AS (SELECT query_id, term, weight FROM terms LEFT JOIN dfs USING (term), stats QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN df IS NULL THEN 0 ELSE weight * {_IDF} END DESC, term) <= 8)"""
_ITEMS = "(SELECT item_id, any_value(text) AS text FROM eval_items WHERE item_id IS NOT NULL GROUP BY item_id)"
_TERMS_ALL = _terms(_ITEMS, "item_id").replace("terms AS", "terms AS", 1)
_BATCH = f"""{_POST}, {_TERMS_ALL}, {_CAP}, {_SCORE.replace('FROM terms', 'FROM capped').replace('JOIN terms', 'JOIN capped')}, batch AS (SELECT query_id, doc_id, score, matched, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS pos FROM ranked QUALIFY pos < 5)"""
_CHUNK = f"""{S.FILES}, {S.SYMBOLS}, {S.CHUNKS}, {S.TEXTS}, cw AS (SELECT chunk_id, c.file_id, list_concat({S.tokens("array_to_string(string_split(content, chr(10))[c.start_line:c.end_line], chr(10))")}, coalesce({S.tokens('s.name')}, []), coalesce({S.tokens('s.name')}, []), {S.tokens('path')}) AS ws
FROM chunks1 c JOIN files2 f ON f.file_id = c.file_id JOIN texts1 t ON t.file_id = c.file_id LEFT JOIN symbols1 s ON s.symbol_id = c.symbol_id WHERE c.end_line >= c.start_line AND c.start_line >= 1),
cpost AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM cw) GROUP BY ALL), {_terms(_VALUES)}"""
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_NT, _QT = S.tokens("name"), S.tokens("text")
_NAME_BASE = f"""CASE WHEN lower(name) = lower(text) OR (contains(text, '.') AND lower(owner || '.' || name) = lower(text)) THEN 3.0 WHEN NOT contains(text, ' ') AND length(text) >= 3 AND starts_with(lower(name), lower(text)) THEN 2.0
WHEN NOT contains(text, ' ') AND length(text) >= 4 AND contains(lower(name), lower(text)) THEN 1.5 WHEN len({_QT}) > 1 AND len(list_filter({_QT}, lambda w: list_contains({_NT}, w))) >= 2 THEN len(list_filter({_QT}, lambda w: list_contains({_NT}, w))) / len({_QT}) ELSE 0 END"""
ORACLES = {
    "bm25_topk": f"WITH {_POST}, {_terms(_VALUES)}, {_SCORE} SELECT query_id, doc_id, score, matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS at FROM ranked QUALIFY at < 10".replace(" AS at ", ' AS "at" ').replace("QUALIFY at", 'QUALIFY "at"'),
    "bm25_filtered_stats": f'WITH {_POST}, {_terms(_VALUES)}, {_SCORE} SELECT query_id, doc_id, score, matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS "at" FROM ranked WHERE source = \'issues\' QUALIFY "at" < 10',
    "term_cap": f"WITH {_POST}, {_TERMS_ALL}, {_CAP} SELECT query_id, term FROM capped",
    "bm25_batch": f'WITH {_BATCH} SELECT query_id, doc_id, score, matched, CAST(pos AS INTEGER) AS "at" FROM batch',
    "bm25_two_level": f"""WITH {_CHUNK}, sizes AS (SELECT file_id, sum(len(ws)) AS len FROM cw GROUP BY file_id HAVING sum(len(ws)) > 0), stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM sizes),
pf AS (SELECT file_id, term, sum(tf) AS tf FROM cpost JOIN cw USING (chunk_id) WHERE term IN (SELECT term FROM terms) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM pf GROUP BY term),
sc AS (SELECT query_id, file_id, round(sum(weight * {_IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM pf JOIN terms USING (term) JOIN dfs USING (term) JOIN sizes USING (file_id), stats GROUP BY ALL)
SELECT query_id, file_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) - 1 AS INTEGER) AS "at" FROM sc QUALIFY "at" < 10""",
    "bm25_chunks": f"""WITH {_CHUNK}, stats AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM cw), dfs AS (SELECT term, count(*) AS df FROM cpost GROUP BY term), size AS (SELECT query_id, count(*) AS size FROM terms GROUP BY query_id),
sc AS (SELECT query_id, chunk_id, sum(weight * {_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg_len))) AS s, count(*) AS matched FROM cpost JOIN terms USING (term) JOIN dfs USING (term) JOIN cw USING (chunk_id), stats GROUP BY ALL)
SELECT query_id, chunk_id, round(s * (0.5 + matched / size), 6) AS score, matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s * (0.5 + matched / size), 6) DESC, chunk_id) - 1 AS INTEGER) AS "at" FROM sc JOIN size USING (query_id) QUALIFY "at" < 10""",
    "dense_topk": f"""WITH {S.CHUNKS}, v AS (SELECT chunk_id, repo_id, vec_q AS v, sqrt({_DOT('vec_q', 'vec_q')}) AS norm FROM chunks1 WHERE vec_q IS NOT NULL AND vec_s > 0 AND len(vec_q) = 128), q AS (SELECT min(chunk_id) AS query_id FROM v GROUP BY repo_id),
s AS (SELECT q.query_id, v.chunk_id, {_DOT('v.v', 'w.v')} / (v.norm * w.norm) AS score FROM q JOIN v w ON w.chunk_id = q.query_id, v WHERE v.norm > 0 AND w.norm > 0)
SELECT query_id, chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""",
    "embedding_topk": f"""WITH v AS (SELECT vec_id, any_value(label) AS label, any_value(embedding) AS v FROM embeddings GROUP BY vec_id), q AS (SELECT min(vec_id) AS query_id FROM v GROUP BY label),
s AS (SELECT q.query_id, v.vec_id, {_DOT('v.v', 'w.v')} / (sqrt({_DOT('v.v', 'v.v')}) * sqrt({_DOT('w.v', 'w.v')})) AS score FROM q JOIN v w ON w.vec_id = q.query_id, v) SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "name_match": f"""WITH {S.SYMBOLS}, s AS (SELECT query_id, symbol_id, round(({_NAME_BASE})::DOUBLE, 6) AS score FROM symbols1, {_NAMES}) SELECT query_id, symbol_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) - 1 AS INTEGER) AS "at" FROM s WHERE score > 0 QUALIFY "at" < 60""",
    "ident_unique_names": rf"""WITH {S.SYMBOLS}, {_POST}, w AS (SELECT doc_id AS query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS ws FROM docs), i AS (SELECT query_id, list_filter(list_filter(ws, lambda x, k: list_position(ws, x) = k),
lambda x: length(x) BETWEEN 3 AND 64 AND (regexp_matches(x, '[A-Za-z0-9]_+[A-Za-z0-9]') OR regexp_matches(x, '[a-z][A-Z]')))[1:48] AS ids FROM w), l AS (SELECT DISTINCT query_id, lower(unnest(ids)) AS low FROM i), c AS (SELECT lower(name) AS low, count(*) AS c FROM symbols1 GROUP BY 1 HAVING count(*) <= 4),
s AS (SELECT query_id, symbol_id, round(max(1.0::DOUBLE / c), 6) AS score FROM l JOIN c USING (low) JOIN symbols1 y ON lower(y.name) = l.low GROUP BY ALL) SELECT query_id, symbol_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) - 1 AS INTEGER) AS "at" FROM s QUALIFY "at" < 200""",
    "popup_match": f"""WITH {S.SYMBOLS}, {S.CALLS}, k AS (SELECT from_symbol AS symbol_id, count(*) AS callers FROM calls1 GROUP BY 1), s AS (SELECT query_id, symbol_id, round((CASE WHEN lower(name) = lower(text) THEN 100.0 WHEN starts_with(lower(name), lower(text)) THEN 60.0 ELSE 30 - (instr(lower(name), lower(text)) - 1) * 0.1 END
+ least(20, coalesce(callers, 0)))::DOUBLE, 6) AS score FROM {_NAMES}, symbols1 LEFT JOIN k USING (symbol_id) WHERE contains(lower(name), lower(text))) SELECT query_id, symbol_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) - 1 AS INTEGER) AS "at" FROM s QUALIFY "at" < 8""",
    "line_windows": f"""WITH {S.TEXTS}, l AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM texts1), w AS (SELECT file_id, ls, s FROM l, unnest(range(1, len(ls) + 1, 60)) AS t(s))
SELECT file_id, CAST(s AS INTEGER) AS start_line, CAST(least(s + 59, len(ls)) AS INTEGER) AS end_line FROM w WHERE regexp_matches(array_to_string(ls[s:s + 59], chr(10)), '[^ \\t\\r\\n]')""",
    "per_group_topk": f"WITH {S.SYMBOLS} SELECT file_id, symbol_id, end_line - start_line AS span FROM symbols1 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY span DESC NULLS LAST, symbol_id) <= 5",
    "outline": f"WITH {S.SYMBOLS} SELECT file_id, name, kind, start_line, signature FROM symbols1 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, symbol_id) <= 30",
    "entry_points": rf"""WITH {S.FILES} SELECT repo_id, file_id, path FROM files2 WHERE lang IS NOT NULL AND NOT is_test AND regexp_extract(path, '([^/.]*)[^/]*$', 1) IN ('main', 'index', 'app', 'server', 'cli', 'mod', 'lib', 'router', 'session', '__main__')
AND len(string_split(path, '/')) - 1 <= 3 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_id) <= 8""",
    "consecutive_dedup": f"WITH {S.CALLS}, c AS (SELECT call_id, file_id, name, lag(name) OVER w AS prev, row_number() OVER w AS rn FROM calls1 WHERE file_id IS NOT NULL WINDOW w AS (PARTITION BY file_id ORDER BY line NULLS FIRST, call_id)) SELECT call_id, file_id, name FROM c WHERE rn = 1 OR name IS DISTINCT FROM prev",
    "token_budget": "WITH d AS (SELECT doc_id, any_value(source) AS source, CAST(ceil(length(any_value(text)) / 4) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL GROUP BY doc_id), s AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM d) SELECT * FROM s WHERE spent <= 20000",
    "language_histogram": f"WITH {S.FILES} SELECT repo_id, lang, count(*) AS n, CAST(sum(lines) AS BIGINT) AS lines FROM files2 WHERE lang IS NOT NULL GROUP BY ALL",
    "distinct_counts": f"WITH {S.CALLS} SELECT repo_id, count(DISTINCT name) AS names, count(DISTINCT file_id) AS files, count(*) AS calls FROM calls1 GROUP BY repo_id",
    "percentile_index": "WITH v AS (SELECT list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL) SELECT len(l) AS n, l[least(floor(len(l) * q / 100.0), len(l) - 1)::INT + 1] AS p, q FROM v, (VALUES (50), (95)) AS t(q)",
    "weighted_quality": f"WITH {S.FILES} SELECT repo_id, round(sum(lines * (CASE lang WHEN 'TypeScript' THEN 0.75 WHEN 'JavaScript' THEN 0.2 WHEN 'Python' THEN 0.4 WHEN 'Ruby' THEN 0.2 WHEN 'Php' THEN 0.5 ELSE 1.0 END)::DOUBLE) / sum(lines), 6) AS quality FROM files2 WHERE lang IS NOT NULL AND lines > 0 GROUP BY repo_id",
    "workspace_search": f"""WITH {_POST}, {_terms('(SELECT * FROM ' + _VALUES + ' WHERE query_id = 1)')}, rs AS (SELECT repo_id, count(*) AS n, avg(len) AS avg_len FROM lens WHERE repo_id IS NOT NULL GROUP BY repo_id), h AS (SELECT l.repo_id, p.doc_id, p.term, p.tf, l.len FROM post p JOIN terms USING (term) JOIN lens l USING (doc_id) WHERE l.repo_id IS NOT NULL),
d AS (SELECT repo_id, term, count(*) AS df FROM h GROUP BY ALL) SELECT repo_id, doc_id, round(sum({_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) * (0.5 + count(*) / (SELECT count(*) FROM terms)), 6) AS score FROM h JOIN d USING (repo_id, term) JOIN rs USING (repo_id) GROUP BY repo_id, doc_id ORDER BY score DESC, doc_id LIMIT 10""",
    "ndcg10": f"""WITH {_BATCH}, lead AS (SELECT item_id, ' ' || array_to_string(({_QT})[1:10], ' ') || ' ' AS lead FROM {_ITEMS}), joined AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS words FROM bag), gold AS (SELECT item_id AS query_id, doc_id FROM joined, lead WHERE contains(words, lead)),
g AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), d AS (SELECT b.query_id, sum(1 / log2(pos + 2)) AS dcg FROM batch b JOIN gold USING (query_id, doc_id) GROUP BY 1), q AS (SELECT query_id FROM batch UNION SELECT query_id FROM gold)
SELECT query_id, coalesce(n, 0) AS n_relevant, round(CASE WHEN n > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM q LEFT JOIN g USING (query_id) LEFT JOIN d USING (query_id)""",
    "acc_at_k": f"""WITH {_BATCH}, lead AS (SELECT item_id, ' ' || array_to_string(({_QT})[1:10], ' ') || ' ' AS lead FROM {_ITEMS}), joined AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS words FROM bag), gold AS (SELECT item_id AS query_id, doc_id FROM joined, lead WHERE contains(words, lead)),
p AS (SELECT g.query_id, bool_and(coalesce(pos < 1, false)) a1, bool_or(coalesce(pos < 1, false)) h1, bool_and(coalesce(pos < 5, false)) a5, bool_or(coalesce(pos < 5, false)) h5 FROM gold g LEFT JOIN batch b USING (query_id, doc_id) GROUP BY g.query_id)
SELECT count(*) AS queries, round(avg(a1::INT::DOUBLE), 6) AS acc1, round(avg(h1::INT::DOUBLE), 6) AS hit1, round(avg(a5::INT::DOUBLE), 6) AS acc5, round(avg(h5::INT::DOUBLE), 6) AS hit5 FROM p""",
}
for _name, _key, _by in (("dense_topk", "chunk_id", "repo_id"), ("embedding_topk", "vec_id", "label")):
    ORACLES[f"{_name}_batch"] = ORACLES[_name].replace(f"SELECT min({_key}) AS query_id FROM v GROUP BY {_by}", f"SELECT {_key} AS query_id FROM v WHERE {_key} % 50 = 0")
