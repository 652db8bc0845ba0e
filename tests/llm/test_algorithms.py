import gc
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphlake.llm import contamination as K
from graphlake.llm import neighbors as V
from graphlake.llm import packing as B
from graphlake.llm import sources as S
from graphlake.llm import spam as M
from graphlake.llm import splitting as C
from graphlake.llm import syntax as Y
from graphlake.llm.grammars import language_of
from graphlake.llm.packrat import Grammar


def greedy(start, end, cuts, limit, overlap):
    out, p = [], start
    while True:
        if end - p + 1 <= limit:
            return [*out, (p, end)]
        fit = [b for b in cuts if start < b <= end and p + overlap < b <= p + limit]
        q = max(fit) - 1 if fit else p + limit - 1
        out.append((p, q))
        p = q - overlap + 1


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 50), st.integers(0, 900), st.lists(st.integers(1, 960), max_size=40))
def test_pieces_are_the_greedy_ones(start, span, cuts):
    assert C.pieces(start, start + span, cuts) == greedy(start, start + span, cuts, 150, 10)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.dictionaries(st.integers(1, 400), st.floats(0, 1), max_size=30))
def test_weighted_pieces_cover_and_fit(span, strength):
    got = C.pieces(1, 1 + span, list(strength), 60, 5, strength)
    assert got[0][0] == 1 and got[-1][1] == 1 + span and all(b - a + 1 <= 60 for a, b in got)
    assert all(q[0] == p[1] + 1 - 5 for p, q in zip(got, got[1:], strict=False))


def test_weak_boundaries_give_way_first():
    assert C.pieces(1, 80, [31, 51], 60, 5, {31: 3.0, 51: 1.0}) == [(1, 30), (26, 80)] and C.pieces(1, 80, [31, 51], 60, 5) == [(1, 50), (46, 80)]
    assert C.pieces(1, 100, [31, 51, 81], 60, 5, {31: 1.0, 51: 3.0, 81: 2.0}) == [(1, 50), (46, 100)]


def test_pieces_of_nothing():
    assert C.pieces(5, 4, []) == [] and C.pieces(5, 5, [5, 6]) == [(5, 5)]
    with pytest.raises(ValueError):
        C.pieces(1, 9, [], 10, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 3))
def test_fm_index_finds_all_places(words, repeat):
    s = np.array(words * repeat)
    index = K.FMIndex(s, 6)
    phrases = np.array([[a, b] for a in range(1, 6) for b in range(1, 6)])
    which, at = index.find(phrases)
    assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == sorted((k, i) for k, p in enumerate(phrases.tolist()) for i in range(len(s) - 1) if s[i : i + 2].tolist() == p)


def test_many_hits_of_one_item_are_chained_in_one_pass():
    import time

    own = np.ones(40, bool)
    seconds = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        assert len(K.spans([(20 * d, d % 37) for d in range(n)], own, 40, 4)) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 40 * seconds[0] + 0.2
    assert K.spans([(d, d) for d in range(30)] + [(500 + d, d) for d in range(30)], own, 40, 4) == [(0, 32, 0, 32, 33, 30), (0, 32, 500, 532, 33, 30)]


def test_vantage_tree_with_factor_one_is_exact():
    rng = np.random.default_rng(2)
    x = V.unit(np.vstack([rng.normal(size=(40, 16)) + c for c in rng.normal(size=(12, 16)) * 3]))
    a, b, _ = V.search(x, x, 5, 0.8, 1.0, leaf=16)
    sims = x @ x.T
    for i in range(len(x)):
        best = sorted((-round(float(sims[i, j]), 5), j) for j in np.flatnonzero(sims[i] >= 0.8))[:5]
        assert {j for _, j in best} == set(b[a == i].tolist()) or sorted(sims[i, b[a == i]].round(4)) == sorted(-v for v, _ in best)


def test_a_dense_cluster_keeps_only_the_best():
    import tracemalloc

    rng = np.random.default_rng(3)
    x = V.unit(rng.normal(size=(1, 32)) + rng.normal(size=(3000, 32)) * 0.02)
    tracemalloc.start()
    a, b, c = V.search(x, x, 6, 0.8, V.relaxed(3000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.bincount(a) == 6).all() and peak < 150e6
    best = np.sort(x @ x.T, axis=1)[:, -6:]
    assert (np.abs(np.sort(c.reshape(-1, 6), axis=1) - best) < 1e-5).mean() > 0.9


def test_the_factor_falls_with_the_depth():
    factors = [V.relaxed(n) for n in (1, 5_000, 10**6, 10**9, 10**12)]
    assert factors == sorted(factors, reverse=True) and factors[0] == V.FACTOR and factors[-1] > 1


def test_equal_vectors_stay_in_one_leaf():
    tree = V.build(V.unit(np.ones((900, 8))), 16)
    assert len(tree.leaves) == 1 and len(tree.leaves[0].rows) == 900


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 64), st.sampled_from("abc")), max_size=120))
def test_packing_loses_nothing_and_overfills_nothing(items):
    lengths, sources = np.array([n for n, _ in items], np.int64), np.array([s for _, s in items], object)
    window = B.pack(lengths, sources, 64, {"a": 0.5, "b": 0.3, "c": 0.2}, {})
    assert (window >= 0).all()
    sums = np.bincount(window, weights=lengths) if len(items) else np.zeros(0)
    assert (sums <= 64).all()
    if len(items):
        assert len(sums) <= max(1, 2 * -(-int(lengths.sum()) // 64))


def test_packing_keeps_proportions():
    rng = random.Random(1)
    lengths = np.array([rng.randrange(20, 60) for _ in range(4000)])
    sources = np.array([rng.choice("aab") for _ in range(4000)], object)
    total = {s: lengths[sources == s].sum() / lengths.sum() for s in "ab"}
    for window in (B.pack(lengths, sources, 1000, total, {}), B.pack(lengths, sources, 1000)):
        for block in range(int(window.max()) // 16):
            here = window // 16 == block
            assert abs(lengths[here & (sources == "a")].sum() / lengths[here].sum() - total["a"]) < 0.03


def test_what_is_owed_is_paid_first():
    lengths, sources = np.full(40, 10), np.array(["a", "b"] * 20, object)
    window = B.pack(lengths, sources, 100, None, {"b": 200})
    assert (window[sources == "b"] == 0).sum() == 10 and window.max() == 3


def test_many_sources_share_queues():
    sources = np.array([f"s{i % 700}" for i in range(3000)], object)
    lengths = np.arange(3000) % 97 + 1
    names = B.queue_names(sources, lengths)
    assert len(set(names)) <= 2 * B.QUEUES and len(set(names) & set(sources)) == B.QUEUES
    assert (B.pack(lengths, names, 128) >= 0).all() and list(B.queue_names(np.array(["x", "y"], object), np.array([1, 2]))) == ["x", "y"]


VALID = {
    "py": ["", "x: int = 1\nif (y := f(x)) > 0:\n    pass\nelse:\n\treturn\n", "def f(a, /, b, *, c=1, **k) -> int:\n    return [i for i in a if i] or {**k}\n", "match x:\n    case [1, *r] if r: pass\n    case P(a=1) | None: pass\n", 's = """\n<<<<<<< a\n"""\n'],
    "js": ["", "import a, { b as c } from 'x'\nexport default class A extends B { #p = 1; static async *m(a = 1, ...r) { yield* r } get x() { return this.#p } }\n", "const r = /[/({]{0,}\\//i, t = `a${f(`{${0}`)}`;\nlabel: for (const [k, v] of m) { if (k) continue label; else break }\n", "a?.b?.[c]?.(d) ?? e ** f; let { x = 1, ...y } = z\nx++\ny--\n"],
    "ts": ["interface A<T extends B = C> { readonly a?: string; [k: string]: number; m<U>(x: U): asserts x is T }\ntype X = A | { [K in keyof B]?: B[K] }\nconst f = async <T,>(x: T): Promise<T[]> => x as unknown as T[];\nenum E { A = 1, B }\n", "abstract class A implements B { constructor(private readonly x: number, y?: string) { super() } }\n"],
    "go": ["package a\n\nimport (\n\t\"x\"\n)\n\nfunc (s *S) f(a, b int, c ...string) (r int, err error) {\n\tfor i := range m {\n\t}\n\tif x := g(); x != nil {\n\t\treturn T{a: 1}, nil\n\t}\n\tselect {\n\tcase v := <-c:\n\tdefault:\n\t}\n}\n", "package a\ntype T[K comparable] struct{ A, B int `j:\"a\"` }"],
    "rs": ["use a::{b, c as d};\npub fn f<'a, T: B + 'a>(x: &'a mut T) -> Result<Vec<T>, E> where T: C { let Some(y) = x.g::<u8>()? else { return Err(E {}) }; match y { A { a, .. } | B(a) if a > 0 => {} _ => v![1; 2] } Ok(vec![]) }\n", "#[derive(A)]\nenum E { A(u8), B { x: i32 } = 1 }\nimpl<T> D for E<T> { const X: u8 = b'a'; fn c(&self) -> impl Fn(u8) -> u8 { move |x| x + 1 } }\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(b = 1) public class C<T extends D & E> extends F<T> implements G { int[] x = {1, 2}; static { y(); } <U> List<? super U> m(final int... a) throws H { for (var v : a) try (R r = s()) { return (x) -> x + 1; } catch (I | J e) { throw e; } return switch (q) { case 1, 2 -> 3; default -> { yield 4; } }; } }\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct s { int a : 3; union { char *b[4]; }; } s_t;\nstatic inline int f(const char *a, int (*g)(void *), ...) { for (int i = 0; i < 3; i++) { *a++ = (char) i; } do { goto x; } while (0); x: return sizeof(struct s) ? a[1] : -1; }\nint v[] = { [0] = 1, .5f, 'a' };\n"]}
INVALID = {
    "py": ["def f(:\n    pass\n", "x = (1\n", "if a:\nb\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "x = 'a\n", "# A page\n\nSome words here.\n", "import a from b\n"],
    "js": ["const x: number = 1;\n", "f(a, (b);\n", "return 1;\n", "}\n", "let x = `a\n", "const x;\n", "<<<<<<< HEAD\n", "import crate::a;\n", "a b\n", "f('a, 1)\n"], "ts": ["const = f(1);\n", "function f(a: number { }\n", "<html>\n"],
    "go": ["", "package a\nfunc f() {\n", "x := 1\n", "package a\nvar = 1\n", "package a\nfunc f() { a( }\n"], "rs": ["fn f( {}\n", "let x = 1;\n", "fn f() { let x = ; }\n", "from a import b\n"],
    "java": ["class A { int f( { } }\n", "class A { void f() { x = ; } }\n", "class A {\n", "class A { void f() { int 1x; } }"], "c": ["int f( { }\n", "int x = ;\n", "pub fn f(a: i64) {}\n", "int f(void) { return g(a; }\n", "# A title\n"]}


@pytest.mark.parametrize("ext", sorted(VALID))
def test_grammars(ext):
    for text in VALID[ext]:
        assert Y.parse(text, ext) == (True, None, None), text
    for text in INVALID[ext]:
        assert not Y.parse(text, ext)[0], text


def test_failures_are_placed():
    assert Y.parse("x = 1\ny = (\n", "py")[1:] == (3, "truncated")
    assert Y.parse("a = 1;\n<<<<<<< HEAD\nb = 1;\n", "js")[1:] == (2, "conflict")
    assert Y.parse("class A { void f() { x = ; } }\n", "java")[1:] == (1, "unexpected")
    assert Y.parse("x", "md") == (True, None, None)


def test_a_parse_leaves_nothing_to_collect():
    texts = {"py": "x = f(a, [1])\n", "js": "x = f(a, [1]);\n", "ts": "let x: A<B> = f(1);\n", "go": "package a\n", "rs": "fn a() { f(1); }\n", "java": "class A { }\n", "c": "int a;\n"}
    for ext, text in texts.items():
        assert Y.parse(text, ext)[0]
    gc.collect()
    gc.disable()
    try:
        for ext, text in texts.items():
            for _ in range(50):
                Y.parse(text, ext)
        assert gc.collect() < 50
    finally:
        gc.enable()


def test_only_rules_that_may_be_asked_again_are_kept():
    kinds, classes = {c: c for c in "abc+()"}, {}
    grammar = Grammar('S <- Sum !.\nSum <- Product ("+" Product)*\nProduct <- Power\nPower <- "(" Sum ")" "b" / "(" Sum ")" / "a"', kinds, classes)
    # Power is asked in one place only, at the start of Product; Product asks nothing but kept rules; Sum loops.
    assert (grammar.once, set(grammar.light)) == ({"Power"}, {"Product"})
    for text in ("a", "a+a", "(a)b+((a+a))", "(" * 60 + "a" + ")" * 60, "", "a+", "(a", "ab", "(a)c"):
        assert grammar.matches(text) == grammar.deep(text)[0], text


def test_the_quick_lexer_reads_the_same_kinds():
    rng = random.Random(3)
    parts = {
        "js": ["a", "return", "/x/g", " ", "\n", "// c\n", "/* d\n */", "(", ";", ",", "=", "/", "`${a}`", "'s'", ".5", "...", ".a", "#p", "}", "rest", "\r\n", "é"],
        "py": ["a", "rb", "'s'", "f'{a!r}'", " ", "\n", "\n    ", "# c", "\\\n", "(", ")", ":", "\"\"\"d\n\"\"\"", "0777", "...", ".a", "\t", "\f", "é"],
        "rs": ["a", "r#b", "b'x'", "r#\"s\"#", "'l", " ", "\n", "// c\n", "/* /* d */ */", "/*", "..", ".a", "::", "{", ";", "<"],
        "c": ["a", "L'x'", "u8\"s\"", "#if X\n", " ", "\n", "// c\n", "/* d\n */", "/*", "...", ".a", "->", "{", ";", "\\\n"],
        "go": ["a", "`s`", "\"s\"", " ", "\n", "\r\n", "// c\n", "/* d\n */", "...", ".a", "<-", "{", "return", ")"],
        "java": ["a", "$b", "\"s\"", "'c'", " ", "\n", "// c\n", "/* d\n */", "...", ".a", "::", "{", "@", "é"],
    }
    for ext, some in {**parts, "ts": parts["js"]}.items():
        language = language_of(ext)
        for _ in range(2000):
            text = "".join(rng.choices(some, k=rng.randrange(1, 14)))
            assert language.read_quick(text)[0] == language.read(text)[0], text


def test_deep_and_long_texts_end():
    assert Y._deep(lambda: Y.parse("x = " + "(" * 3000 + "1" + ")" * 3000 + "\n", "py"))[0]
    assert Y.parse("f(a, 1);\n" * 40_000, "js")[0]


def test_nesting_has_no_bound():
    deep = lambda n: "x = " + "(" * n + "1" + ")" * n + "\n"
    assert Y._deep(lambda: Y.parse(deep(100_000), "py")) == (True, None, None)
    assert Y._deep(lambda: Y.parse("(" * 200_000, "py")) == (False, 1, "truncated")
    with pytest.raises(ZeroDivisionError):
        Y._deep(lambda: 1 // 0)
    for ext in VALID:
        grammar = Y.language_of(ext).grammar
        for text in VALID[ext] + INVALID[ext]:
            kinds = Y.language_of(ext).read(text)[0]
            assert grammar.deep(kinds)[0] == grammar.matches(kinds), text
            assert grammar.matches(kinds) or grammar.deep(kinds)[1] == grammar.furthest(kinds), text


def test_targets_arguments_and_parameters():
    good = {
        "py": ["f(a, *b, c=1, *d, **e, g=2)\n", "def f(a, /, b=1, *, c, d=2, **e): pass\n", "def f(*a: int, b, **c): pass\n", "x = lambda a, b=1, *c, d, **e: a\n", "(a).b = c[1] = [d, *e] = f().g = 1\n", "x: int = 00\n", "(x): int = 0_0\n", "f(i for i in a)\n", "a.b().c[1:2] += 1\n", "with f() as a, (yield) as b.c: pass\n", "for a.b, (c[0], *d) in e: pass\n", "x = lambda *, a: a\n"],
        "js": ["[a, b] = c; ({ a } = b);\n", "a.b[c] ||= d => e = f;\n", "let x = y = 2; x = y += z;\n", "new.target; new a.b(c);\n", "export default function () {}\n", "x = function () {}; (function () {})();\n"]}
    bad = {
        "py": ["1 = x\n", "x = 1 = y\n", "f() = 1\n", "f() += 1\n", "'a' += b\n", "None = 1\n", "f(a=1, 2)\n", "f(**a, *b)\n", "x = g(f(a=1, b))\n", "def f(a=1, b): pass\n", "def f(*): pass\n", "def f(**a, b): pass\n", "x = lambda a=1, b: a\n", "x = 08\n", "f'{a b}'\n"],
        "js": ["1 = 2;\n", "'a' = b;\n", "null += 1;\n", "let let = 1;\n", "const let = 1;\n", "function () { }\n", "new.foo;\n"]}
    assert [t for ext, texts in good.items() for t in texts if not Y.parse(t, ext)[0]] == []
    assert [t for ext, texts in bad.items() for t in texts if Y.parse(t, ext)[0]] == []


def test_elements_in_scripts():
    good = [
        "const a = <b c=\"d\" e={f} {...g}>It's {h ? <i/> : null} text{/* note */}</b>;\n", "function A() {\n  return (\n    <>\n      <A.B x='1' y />\n      {xs.map(x => <li key={x}>{x}</li>)}\n    </>\n  );\n}\n",
        "const less = a < b, more = c > d;\n", "export default () => <div>{`a${<b/>}`}</div>;\n".replace("`a${<b/>}`", "f(<b/>, {c: 1})")]
    bad = ["const a = <b>;\n", "const a = <b></c>;\n", "x = <b c=1/>;\n", "x = <b>{a b}</b>;\n", "x = <b>}</b>;\n", "x = <b>{(a}</b>;\n", "x = <b c={}/>{;\n"]
    assert [t for t in good if not Y.parse(t, "jsx")[0]] == []
    assert [t for t in bad if Y.parse(t, "jsx")[0]] == []
    assert Y.parse("x = 1;\ny = <b>\n  {c +}\n</b>;\n", "jsx")[:2] == (False, 3)
    assert not Y.parse("x = <b/>;\n", "js")[0]


def test_python_grammar_agrees_with_the_interpreter():
    import ast
    import sysconfig
    from pathlib import Path

    for path in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:70]:
        text = path.read_text(errors="replace")
        ast.parse(text)
        assert Y._deep(lambda t=text: Y.parse(t, "py"))[0], path


def test_spam_and_ordinary_pages():
    spam = [
        "cheap pro - free tool - best filter - cheap pro - free tool - best filter - cheap pro", "#one #two #three #four #five #six #seven #eight #nine", "https://a.example/x\nhttps://b.example/y\nhttps://c.example/z\nhttps://d.example/w\n",
        "Our best pro is the best pro that best pro users call the best best pro. Get best pro now, best pro today, best pro for every need!", "SKU 4 Alpha red\nBeta | 9.99 | Buy now | blue\nGamma - only 3 credits - add to cart [x]\n" * 3]
    fine = [
        None, "", "   \n", "The parser reads every file once and then keeps a list of its callers in memory.\n\nLinks:\n- https://a.example/x\n- https://b.example/y\n", "Wenn mehr als 9 Dateien offen sind, bricht der Aufruf ohne Meldung ab.",
        "# Title\n\n```\nload --a b\nrun --c d\n```\n\nWe moved the module because nobody owned it, and it is safe to delete the old one."]
    assert [M.page_statistics(t)["spam"] for t in spam] == [True] * len(spam)
    assert [M.page_statistics(t)["spam"] for t in fine] == [False] * len(fine)


def test_layout_tells_data_and_copies():
    hexes = "export const A = [\n" + "  0xad, 0x0c, 0xb7, 0x3d,\n" * 40 + "];\n"
    words = S._WORDS.findall(hexes)
    assert S.layout(hexes, words)["number_share"] > 0.6
    assert S.marks("// Code generated by x; DO NOT EDIT.\npackage a\n") == (True, False, False)
    assert S.marks("// Unlike the generated client this one is kept by hand.\n// Checks whether a file is generated.\n") == (False, False, False)
    assert S.marks('package a\n\nvar x = "// Code generated by y. DO NOT EDIT."\n') == (False, False, False)
    base = [f"w{i}" for i in range(400)]
    a, b = S.Sketch().signature(base)[1], S.Sketch().signature([*base[:200], "new", *base[201:]])[1]
    assert (a == b).mean() > 0.85 and S.Sketch().signature(["x"])[1] is None


def test_tokenizer_pattern_is_the_published_one():
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    text = "It's 3 naïve  tests,\n\tdon't 'LL a_b  ¿qué? \n\n end "
    mine = B._encoding(B.TOKENIZER)
    assert mine.encode_ordinary(text) == tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=mine._mergeable_ranks, special_tokens={}).encode_ordinary(text)
