import random
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest

from graphlake.llm import contamination as K
from graphlake.llm import neighbors as V
from graphlake.llm import packing as B
from graphlake.llm import sources as S
from graphlake.llm import spam as M
from graphlake.llm import splitting as C
from graphlake.llm import syntax as Y

T = datetime(2024, 1, 1)
FILES = "file_id int, repo_id string, path string, indexed_at timestamp, content int, reasons int"
TEXTS = "file_id int, repo_id string, content string, path int"


def test_split_handles_dirty_rows(spark):
    items = spark.createDataFrame([(1, 5, 1, 400, "x"), (2, 5, 1, 150, "x"), (3, None, 1, 300, "x"), (4, 5, None, 300, "x"), (5, 5, 300, 1, "x"), (None, 5, 1, 300, "x"), (6, 5, 1, 20_000, "x")], "item long, place int, first int, last int, cuts string")
    marks = spark.createDataFrame([(5, 100), (5, 100), (5, None), (None, 7), (5, 9000)], "place int, at int")
    got = {}
    for r in C.split_oversized(items, marks).collect():
        got.setdefault(r["item"], []).append((r["piece_start"], r["piece_end"]))
    assert sorted(got[1]) == C.pieces(1, 400, [100]) and sorted(got[3]) == C.pieces(1, 300, []) and sorted(got[6]) == C.pieces(1, 20_000, [100, 9000]) and set(got) == {1, 3, 6}
    assert C.split_oversized(items.limit(0), marks.limit(0)).count() == 0


def test_neighbours_match_brute_force_with_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-90, 90, (30, 16))
    rows = [(i, np.clip(centres[i % 30] + rng.integers(-12, 12, 16), -127, 127).astype(int).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[0][1]) for i in range(12)] + [(2000, None), (2001, [0] * 16), (2002, [1, 2]), (None, rows[3][1])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, vec array<byte>, other_id string")
    got = {}
    for r in V.similar_vectors(df, factor=1.0, dims=16).collect():
        got.setdefault(r["vec_id"], set()).add(r["other_id"])
    good = {k: np.array(v, float) for k, v in rows if k is not None and v and len(v) == 16 and any(v)}
    for k, v in good.items():
        sims = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), j) for j, w in good.items() if j != k)
        assert got.get(k, set()) == {j for s, j in sims[:5] if -s >= 0.8}
    assert V.similar_vectors(df.limit(0), dims=16).count() == 0


def test_hot_shards_are_cut_again(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("ROUTER_SAMPLE", 64), ("LEAF_ROWS", 8), ("_CUT_ROWS", 90)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(9)
    x = np.vstack([np.clip(c + rng.integers(-9, 9, (9, 16)), -127, 127) for c in rng.integers(-90, 90, (90, 16))]).astype(int)
    x[800:] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<byte>")
    cuts = []
    cut_hot = V.cut_hot
    monkeypatch.setattr(V, "cut_hot", lambda *a: cuts.append(cut_hot(*a)) or cuts[-1])
    got = {(r["vec_id"], r["other_id"]) for r in V.similar_vectors(df, factor=1.0, dims=16).collect()}
    q = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(q @ q.T, 12)
    np.fill_diagonal(sims, -1)
    want = {(i, j) for i in range(len(x)) for j in sorted(np.flatnonzero(sims[i] >= 0.8), key=lambda j: (-sims[i, j], j))[:5]}
    sizes = [r["count"] for r in cuts[0].where("home").groupBy("shard").count().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 80, sizes
    assert len(got & want) >= 0.995 * len(want) and len(got) == len(want)  # equal rounded cosines may change places


def _written(spark):
    """Bytes of the shuffle files of a local session and of its checkpoint folder."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(f.toString()) for f in manager.localDirs()] + [Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))]
    return sum(p.stat().st_size for f in folders for p in f.rglob("*") if p.is_file())


def test_vectors_are_not_copied_to_the_shards_that_they_ask(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD_ROWS", 300)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(3000, 128)), 4, axis=0) + rng.normal(size=(12_000, 128)) * 0.4
    x = (x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<byte>")
    before = _written(spark)
    assert V.similar_vectors(df).count() > 30_000
    assert _written(spark) - before < 4 * x.size


def test_the_newest_vector_of_a_chunk_counts(spark, tmp_path):
    a, b, c = ([d if i == at else 1 for i in range(128)] for at, d in ((3, 120), (3, 110), (90, 120)))
    rows = [(1, a, 0.1, datetime(2024, 1, 1)), (2, b, 0.1, T), (2, b, 0.1, datetime(2024, 2, 1)), (3, a, 0.1, T), (3, c, 0.1, datetime(2024, 3, 1)), (4, a, 0.1, T), (4, None, 0.1, datetime(2024, 3, 1)), (5, a, 0.0, T), (None, a, 0.1, T)]
    spark.createDataFrame(rows, "chunk_id long, vec_q array<byte>, vec_s float, indexed_at timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    assert [tuple(r) for r in V.p3_found(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_packing_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_PIECES", 40)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 3, 90, 500, 2048, 2049, 5000]) if i % 3 else rng.randrange(1, 600), rng.choice(["a", "b", None])) for i in range(400)] + [(None, 5, "a"), (900, None, "a")]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, n_tokens long, source string, window string")
    out = B.pack_documents(df).toPandas()
    size = {d: n or 0 for d, n, _ in rows if d is not None}
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == size
    assert out.groupby("window_id")["n_tokens"].sum().max() <= 2048 and out["n_tokens"].max() <= 2048
    assert out.groupby("doc_id").size().to_dict() == {d: max(1, -(-n // 2048)) for d, n in size.items()}
    assert out["n_tokens"].sum() / (out["window_id"].nunique() * 2048) > 0.95
    assert B.pack_documents(df.limit(0)).count() == 0


def test_equal_lengths_stay_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_PIECES", 100)
    df = spark.createDataFrame([(i, 1500, f"s{i % 5}") for i in range(1200)], "doc_id long, n_tokens long, source string")
    out = B.pack_documents(df).toPandas()
    assert len(out) == 1200 and out["window_id"].nunique() == 1200 and out.groupby("part").size().max() <= 150
    fixed = B.pack_documents(df, share={f"s{k}": 0.2 for k in range(5)}).toPandas()
    assert sorted(fixed["doc_id"]) == list(range(1200))


def test_packing_checks_tell_faults(spark):
    sizes = spark.createDataFrame([(1, 90, "a"), (2, 9, "b"), (3, 5, "b")], "doc_id long, n_tokens long, source string")
    good = B.pack_documents(sizes, capacity=104)
    assert B.packing_checks(good, sizes, 104).first().asDict() == {"documents": 3, "changed": 0, "overfull": 0, "filled": True, "in_proportion": True}
    row = B.packing_checks(good.where("doc_id <> 2"), sizes, 94).first()
    assert row["changed"] == 1 and row["overfull"] == 1


def test_tokens_of_null_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in B.count_tokens(df, "text").collect()}
    assert got[1] == got[2] == 0 and got[3] > 40_000 and got[4] > 1


LEAK = " ".join(f"alpha{i} beta{i % 7} gamma{i}" for i in range(20))


def test_contamination_cases(spark):
    words = LEAK.split()
    shared = "its entries then tells where the rest of all marks went for good"
    items = spark.createDataFrame([(1, LEAK), (2, f"{shared} one two three four five six"), (3, f"{shared} seven eight"), (4, f"{shared} nine"), (5, None), (6, ""), (None, LEAK), (1, LEAK), (7, "tiny text")], "item_id long, text string")
    noise = lambda n: [f"n{i}" for i in range(n)]
    changed = [w if i % 12 else "xx" for i, w in enumerate(words)]
    docs = {
        10: " ".join([*noise(40), *words, *noise(5)]), 11: " ".join([*noise(9), *words[:26]]), 12: " ".join([*noise(9), *words[:10]]), 13: "> " + "\n> ".join(" ".join(words[i : i + 6]).upper() + "," for i in range(0, 60, 6)),
        14: " ".join(changed), 15: shared, 16: None, 17: "", 18: " ".join(noise(9000)) + " " + LEAK, 19: "<p>" + LEAK.replace("beta3", "<b>beta3</b>") + "</p>", 20: " ".join([*noise(40), *words, *noise(5)]), 21: " ".join(reversed(words))}
    df = spark.createDataFrame([(k, v, k) for k, v in docs.items()] + [(10, docs[10], 1), (None, LEAK, 0)], "doc_id long, text string, item_id int")
    got = sorted({(r["doc_id"], r["item_id"]) for r in K.contaminated(df, items).collect()})
    assert got == [(d, 1) for d in (10, 11, 13, 14, 18, 19, 20)]
    assert K.contaminated(df.limit(0), items).count() == 0 and K.contaminated(df, items.limit(0)).count() == 0


def test_every_copy_in_a_document_is_removed(spark):
    noise = lambda n, k: " ".join(f"n{k}q{i}" for i in range(n))
    items = spark.createDataFrame([(1, LEAK), (2, " ".join(f"own{i} else{i}" for i in range(20)))], "item_id long, text string")
    two = " ".join(f"own{i} else{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{noise(30, 1)} {LEAK} {noise(50, 2)} {LEAK} {two}"), (2, noise(9, 3))], "doc_id long, text string")
    runs = K.contaminated(docs, items)
    assert sorted((r["item_id"], r["first_word"], r["last_word"]) for r in runs.collect()) == [(1, 30, 89), (1, 140, 199), (2, 200, 239)]
    assert sorted((r["first_word"], r["last_word"], r["items"]) for r in K.removal_spans(runs).collect()) == [(30, 89, [1]), (140, 239, [1, 2])]
    assert K.removal_spans(runs.limit(0)).count() == 0


def test_items_in_blocks_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(12)], "item_id long, text string")
    docs = items.selectExpr("item_id + 100 AS doc_id", "text")
    monkeypatch.setattr(K, "ITEM_BLOCK", 5)
    assert sorted((r["doc_id"], r["item_id"]) for r in K.contaminated(docs, items).collect()) == [(i + 100, i) for i in range(12)]


def test_sources(spark):
    word = lambda i: "".join("abcdefghij"[int(d)] * 2 for d in f"{i:03d}")
    text = lambda seed: "\n".join(f"def {word(seed + i)}(alpha, {word(i)}):\n    return {word(seed + 3 * i)}(alpha) + {word(7 * i)}" for i in range(30))
    hand = text(100)
    near = hand.replace(f"return {word(130)}(", "return changed(")
    rows = [
        (1, "a", "src/a.py", "# Code generated by tool; DO NOT EDIT.\nx = 1\n"), (2, "a", "src/b.py", hand), (3, "b", "lib\\c.py", near), (4, "a", "./vendor/liba/liba_x.py", "y = 2\n"), (5, "a", "app/vendor/route/z.py", "z = 2\n"), (6, "a", "docs/x.md", "Code generated by x"),
        (7, "a", "x/y.min.js", None), (8, "a", "x/empty.py", ""), (9, "a", None, "x"), (10, "a", "src/d.js", "a=b(c,d);" * 400), (11, "a", "src/e.py", text(500)), (None, "a", "q.py", "x")]
    files = spark.createDataFrame([(i, r, p, T, 0, 0) for i, r, p, _ in rows] + [(1, "a", "src/a.py", T, 0, 0)], FILES)
    texts = spark.createDataFrame([(i, r, t, 0) for i, r, _, t in rows] + [(1, "a", rows[0][3], 0), (99, "a", "orphan", 0)], TEXTS)
    got = {r["file_id"]: r["reasons"] for r in S.not_hand_written(files, texts).collect()}
    assert set(got) == {1, 2, 3, 4, 7, 10} and got[1] == ["marked"] and got[2] == got[3] == ["spread"] and got[4] == ["vendored"] and got[7] == ["named"] and got[10] == ["minified"]
    assert S.not_hand_written(files.limit(0), texts.limit(0)).count() == 0


def test_near_copies_are_compared_by_their_shingles(spark):
    import numpy as np

    sketch = S.Sketch()
    shingles = lambda text: set(sketch.shingles(sketch.hashes(text.split())).tolist())
    agree = lambda a, b: (sketch.signature(a.split())[1] == sketch.signature(b.split())[1]).sum()
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    rows = []
    for seed in range(400):
        words = [f"w{seed}x{i}" for i in range(300)]
        near = list(words)
        for at in np.random.default_rng(seed).choice(60, 6, replace=False) * 5:
            near[at] = f"v{at}"
        a, b = " ".join(words), " ".join(near)
        if jaccard(a, b) >= 0.80 and S.LEAST_AGREE <= agree(a, b) < 52:
            rows += [(a, "p"), (b, "q")]
    assert len(rows) >= 4
    base = [f"f{i}" for i in range(300)]
    chain = [" ".join([f"g{i}" if i % 75 < 12 and i // 75 < k else w for i, w in enumerate(base)]) for k in range(4)]
    assert jaccard(chain[0], chain[3]) < 0.8 <= jaccard(chain[2], chain[3])
    rows += [(chain[0], "p"), (chain[1], "p"), (chain[2], "p"), (chain[3], "q"), ("int add(int a, int b);", "p"), ("int add(int a, int b);", "q"), ("int x;", "p"), ("int x;", "q")]
    files = spark.createDataFrame([(i, r, f"src/f{i}.c", T, 0, 0) for i, (_, r) in enumerate(rows)], FILES)
    texts = spark.createDataFrame([(i, r, t, 0) for i, (t, r) in enumerate(rows)], TEXTS)
    n = len(rows)
    got = {r["file_id"] for r in S.not_hand_written(files, texts).collect() if "spread" in r["reasons"]}
    want = set(range(n - 8)) | {n - 3, n - 4, n - 5, n - 6} | {k for k in range(n - 8, n - 4) if any(rows[j][1] != rows[k][1] and jaccard(rows[k][0], rows[j][0]) >= 0.8 for j in range(n - 8, n - 4))}
    assert got == want - {n - 1, n - 2} and n - 6 in got


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    rows = [(" ".join([*base[:k], f"v{k}", *base[k + 1 :]]), "p") for k in range(10, 40)] + [(" ".join([*base[:99], "z", *base[100:]]), "q")]
    rows += [(" ".join(f"alone{i}" for i in range(300)), "p")]
    files = spark.createDataFrame([(i, r, f"src/f{i}.c", T, 0, 0) for i, (_, r) in enumerate(rows)], FILES)
    texts = spark.createDataFrame([(i, r, t, 0) for i, (t, r) in enumerate(rows)], TEXTS)
    found = lambda: {r["file_id"] for r in S.not_hand_written(files, texts).collect() if "spread" in r["reasons"]}
    whole = found()
    monkeypatch.setattr(S, "BLOCK", 4)
    assert found() == whole == set(range(31))
    monkeypatch.setattr(S, "_leads", lambda met, still: met.sparkSession.createDataFrame([], "a long, b long"))
    assert found() == whole


def test_syntax(spark):
    rows = [(1, "a", "x.py", "x = (\n"), (2, "a", "y.py", "x = 1\n"), (3, "a", "z.md", "x = (\n"), (4, "b", "w.js", None), (5, "b", "v.js", ""), (6, "b", "u.go", ""), (7, None, "t.c", "int x = ;\n"), (8, "a", None, "x"), (9, "a", "s.JAVA", "class {\n")]
    files = spark.createDataFrame([(i, r, p, T, 0, 0) for i, r, p, _ in rows] + [(1, "a", "x.py", T, 0, 0)], FILES)
    texts = spark.createDataFrame([(i, r, t, 0) for i, r, _, t in rows] + [(1, "a", "x = (\n", 0)], TEXTS)
    checked = Y.parsed(files, texts)
    got = {r["file_id"]: (r["valid"], r["cause"]) for r in checked.collect()}
    assert got == {1: (False, "truncated"), 2: (True, None), 5: (True, None), 6: (False, "truncated"), 7: (False, "unexpected"), 9: (False, "unexpected")}
    assert {(r["repo_id"], r["ext"]): r["rate"] for r in Y.invalid_rates(checked).collect()}[("a", "py")] == 0.5
    assert Y.parsed(files.limit(0), texts).count() == 0


def test_fields_of_strings_are_parsed():
    valid = {
        "js": ["x = `a${b}c${f(`d${e}`, {k: 1})}`;\n", "x = `\\${ (` + `${() => 1}`;\n", "x = `${a ? `${b}` : ''}`;\n"],
        "py": ['x = f"{a}{b!r:>{w}}{{c}}{d=}"\n', 'x = f"{a:%Y-%m-%d}{b[1:2]}{c if d != e else (lambda: 1)()}"\n', 'x = f"\\N{DASH}{a}" "{"\n', 'x = f"""{\na}"""\n', 'x = rf"\\d{{2}}{a}"\n']}
    faulty = {"js": ["x = `a${b +}c`;\n", "x = `${}`;\n", "x = `\n${f(`${1 2}`)}`;\n", "x = `${a b}`;\n"], "py": ['x = f"{a +}"\n', 'x = f"{}"\n', 'x = f"{a b}"\n', 'x = f"{a:{b c}}"\n']}
    for ext, texts in valid.items():
        assert [t for t in texts if not Y.parse(t, ext)[0]] == []
    for ext, texts in faulty.items():
        assert [t for t in texts if Y.parse(t, ext)[0]] == []
    assert Y.parse(faulty["js"][2], "js") == (False, 2, "unexpected")


def test_spam_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "#a #b #c #d #e #f #g #h #i", 0), (3, "#a #b #c #d #e #f #g #h #i", 0), (None, "x", 0), (4, "It is a sentence that has words in it. " * 5000, 0)], "doc_id long, text string, spam int")
    assert {r["doc_id"]: r["spam"] for r in M.spam_statistics(df).collect()} == {1: False, 2: False, 3: True, 4: False}
    assert M.spam_statistics(df.limit(0)).count() == 0


def test_spam_of_repeated_phrases_and_menu_paths():
    phrase = "the best tool for the fast build of your graph"
    around = "The cache is rebuilt after the session has been closed. It holds what the reader has seen so far.\n"
    trail = "Home > Planner > Bridge > Sensor\nStart > Router > Session\nIndex > Parcel > Anchor > Reader\n" * 3
    spam = lambda text: M.page_statistics(text)["spam"]
    assert spam(f"{phrase}\n" * 40) and spam(f"{phrase} " * 40) and spam(f"{phrase}!\n" * 40) and spam(trail)
    assert not spam(f"{phrase}\n" * 2) and not spam(around * 2 + f"{phrase}\n" * 3) and not spam(around * 8 + trail)
    assert not spam("if (a > b) {\n  return a > c;\n}\n" * 8)


def test_each_statistic_can_decide():
    why = lambda text, lang=None: set(filter(None, M.page_statistics(text, lang)["reasons"].split(",")))
    prose = "The cache is rebuilt after the session has been closed. It holds what the reader has seen so far, and nobody else may change it.\n"
    assert why("[red pump](https://a.example/x)\n" * 9) == {"links"}
    assert "no function words" in why("pump garden red hose clamp valve seal tube nozzle filter") and "no function words" in why("pumpe garten schlauch rot ventil dichtung rohr filter", "de")
    assert "word" in why("Our pump is the pump that the owners of a pump call the pump of all. Get a pump now, for a pump is what you and the others need.")
    assert "pair" in why("get the hose clamp or a hose clamp for the hose clamp and with a hose clamp on the hose clamp of a hose clamp you are in the hose clamp")
    assert "lines" in why(prose + "the best tool for the fast build\n" * 12)
    assert not why(prose * 9) and not why(prose + "[red pump](https://a.example/x)\n" * 3)
    table = "".join(f"get_{i} | returns int | stable\n" for i in range(30))
    assert not why(table) and not why(prose + table) and not why("a_b = c(d);\n" * 40)
    assert not why(prose + "```\n" + "red pump hose\n" * 40 + "```\n") and M.page_statistics("\ufeff \x00 ?!")["spam"] is False


def test_spam_takes_any_columns(spark):
    df = spark.createDataFrame([(1, "pump garden red hose clamp valve seal tube nozzle filter", "xx", "y"), (2, None, None, None)], "doc_id int, text string, lang string, reasons string")
    assert {r["doc_id"]: (r["lang"], r["spam"]) for r in M.spam_statistics(df).collect()} == {1: ("en", True), 2: ("en", False)}


def test_queries_run_on_files(spark, tmp_path):
    """Every pN_ query on tables of a few rows with nulls."""
    import graphlake.llm as L

    d = str(tmp_path)
    spark.createDataFrame([(1, "a", "x.py", T), (2, None, None, None)], "file_id int, repo_id string, path string, indexed_at timestamp").write.parquet(f"{d}/files.parquet")
    spark.createDataFrame([(1, "a", "x = ("), (2, None, None)], "file_id int, repo_id string, content string").write.parquet(f"{d}/file_texts.parquet")
    spark.createDataFrame([(1, 1, 1, 400, None, None, T), (2, None, None, None, None, None, None)], "chunk_id long, file_id int, start_line int, end_line int, vec_q array<byte>, vec_s float, indexed_at timestamp").write.parquet(f"{d}/chunks.parquet")
    spark.createDataFrame([(1, 1, 5, None, None, "class")], "symbol_id int, file_id int, start_line int, parent int, owner string, kind string").write.parquet(f"{d}/symbols.parquet")
    spark.createDataFrame([(1, "some text", "s"), (2, None, None)], "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "some text")], "item_id long, text string").write.parquet(f"{d}/eval_items.parquet")
    got = {name: query(spark, d).count() for name, query in L.QUERIES.items()}
    assert got["p2_found"] == 3 and got["p5_found"] == 1 and got["p6_windows"] == 2 and got["p3_found"] == 0
    assert set(got) == {"p1_found", "p1_reasons", "p2_found", "p2_outer", "p3_found", "p5_found", "p5_failures", "p5_rates", "p6_windows", "p6_checks", "p7_found", "p7_spans", "p8_found"}


@pytest.mark.parametrize("k", [1, 3])
def test_smallest_per_group(spark, k):
    from graphlake.llm.shards import smallest_per_group

    df = spark.createDataFrame([("a", i % 9) for i in range(100)] + [("b", None), ("b", 4)], "g string, v int").repartition(5)
    assert {r["g"]: r["ids"] for r in smallest_per_group(df, "g", "v", k).collect()} == {"a": list(range(k)), "b": [4]}
