"""Entity resolution: import specs to files, calls to symbols, positions and names to targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions import paths as P

CONTAINERS = ("class", "struct", "interface", "trait", "enum", "module")
CALLABLE = ("function", "method", "macro", "class", "struct")
SELF_NAMES = ("this", "self", "Self", "cls", "super", "me")
SAME_PACKAGE = ("Go", "Java", "CSharp", "Rust", "Kotlin", "Swift")
# A name that more symbols of a repository share than this resolves to none of them.
MOST_CANDIDATES, MOST_TARGETS = 400, 3
# Method names that say too little to be resolved by being unique.
GENERIC_METHODS = (
    "get set has add delete remove push pop map filter reduce find some every join split slice concat includes keys values entries then catch "
    "on off emit send write read close open start stop run call apply bind update clear next len iter unwrap expect clone into from new "
    "default append extend insert items format log error warn info debug init create load save parse render handle process execute build equals "
    "size length contains copy reset flush wait lock use each list sort test exec query fetch post put patch match replace trim lower upper").split()
_JS_TRIES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".d.ts")
_JS_SWAPS = ((".js", ".ts"), (".js", ".tsx"), (".jsx", ".tsx"), (".mjs", ".mts"))
_JS_INDEX = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs")
# Files of a package that one import may stand for.
PACKAGE_FILES = 24


def _none() -> Column:
    return F.array().cast("array<string>")


def _ancestors(directory: Column) -> Column:
    """The directory, its parents, and '' last."""
    parts = F.filter(F.split(directory, "/"), lambda s: s != "")
    return F.concat(F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - i, F.lit(0))), "/")), F.array(F.lit("")))


def _js_tries(base: Column) -> Column:
    plain = F.array(*[F.concat(base, F.lit(e)) for e in _JS_TRIES])
    swaps = F.filter(F.array(*[F.when(base.endswith(a), F.concat(F.regexp_replace(base, a.replace(".", r"\.") + "$", ""), F.lit(b))) for a, b in _JS_SWAPS]), lambda x: x.isNotNull())
    index = F.array(*[F.when(base == "", F.lit(i)).otherwise(F.concat(base, F.lit("/"), F.lit(i))) for i in _JS_INDEX])
    return F.concat(plain, swaps, index)


def import_candidates(path: Column, lang: Column, spec: Column) -> Column:
    """The paths that an import may mean, in order of preference; [] where only names can tell."""
    directory = P.parent_dir(path)
    up = _ancestors(directory)
    rest = F.substr(spec, F.lit(3))
    alias = F.flatten(F.transform(up, lambda d: F.concat(
        F.array(F.when(d == "", F.concat(F.lit("src/"), rest)).otherwise(F.concat(d, F.lit("/src/"), rest))),
        F.when((d == "src") | d.endswith("/src"), F.array(P.join(d, rest))).otherwise(_none()))))
    bases = F.when(spec.startswith("."), F.array(P.join(directory, spec))).when(spec.rlike("^[@~]/"), F.concat(alias, F.array(rest))).otherwise(_none())
    js = F.flatten(F.transform(bases, _js_tries))

    modules = lambda base: F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit(".pyi")))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    climbed = F.element_at(up, F.least(F.greatest(dots, F.lit(1)), F.size(up)))
    tail = F.replace(F.substr(spec, dots + 1), F.lit("."), F.lit("/"))
    relative = F.replace(spec, F.lit("."), F.lit("/"))
    roots = F.concat(F.array(F.lit(""), F.lit("src")), F.filter(up, lambda d: d != ""))
    python = F.when((dots > 0) & (tail == ""), F.array(P.join(climbed, F.lit("__init__.py")))).when(dots > 0, modules(P.join(climbed, tail))).otherwise(
        F.flatten(F.transform(roots, lambda r: modules(P.join(r, relative)))))

    include = F.array(P.join(directory, spec), P.normalize(spec))
    ruby_spec = F.regexp_replace(spec, r"(\.rb)+$", "")
    ruby = F.transform(F.array(directory, F.lit("lib"), F.lit("app"), F.lit("")), lambda d: F.concat(P.join(d, ruby_spec), F.lit(".rb")))

    name = P.file_name(path)
    module_dir = F.when(name.isin("lib.rs", "main.rs", "mod.rs"), directory).otherwise(P.join(directory, P.strip_ext(name)))
    both = lambda base: F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs")))
    head = F.trim(F.regexp_replace(F.regexp_replace(spec, r"::\{[\s\S]*$", ""), r" as [\s\S]*$", ""))
    segments = F.filter(F.split(head, "::"), lambda s: (s != "") & (s != "*"))
    supers = F.size(F.filter(segments, lambda s: s == "super"))
    above = _ancestors(module_dir)
    base = F.when(F.element_at(segments, 1) == "self", module_dir).when(F.element_at(segments, 1) == "super", F.element_at(above, F.least(supers + 1, F.size(above))))
    after = F.when(F.element_at(segments, 1) == "super", F.slice(segments, supers + 1, F.size(segments))).otherwise(F.slice(segments, 2, F.size(segments)))
    deep = F.when(F.size(after) > 0, F.flatten(F.transform(F.sequence(F.size(after), F.lit(1), F.lit(-1)), lambda k: both(P.join(base, F.array_join(F.slice(after, 1, k), "/")))))).otherwise(_none())
    rust = F.when(spec.startswith("mod:"), both(P.join(module_dir, F.substr(spec, F.lit(5))))).when(
        (F.size(segments) > 0) & base.isNotNull(), F.concat(deep, F.array(P.join(base, F.lit("lib.rs")), P.join(base, F.lit("main.rs"))))).otherwise(_none())

    return (
        F.when(lang.isin("TypeScript", "Tsx", "JavaScript"), js).when(lang == "Python", python).when(lang.isin("C", "Cpp"), include).when(lang == "Ruby", ruby)
        .when(lang == "Rust", rust).otherwise(_none()))


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo_id, src, dst): the files that each file imports, itself excluded, each once.

    files: repo_id, file_id, path, lang, is_test.  imports: repo_id, file_id, spec.  First the candidate paths
    in order, then, where a language allows, files and directories whose path ends like the spec.
    """
    code = files.where(F.col("lang").isNotNull()).select("repo_id", "file_id", "path", "lang", "is_test")
    wanted = imports.join(code, ["repo_id", "file_id"]).select("repo_id", F.col("file_id").alias("src"), "path", "lang", "spec")
    tried = wanted.select("repo_id", "src", "spec", F.posexplode(import_candidates(F.col("path"), F.col("lang"), F.col("spec"))).alias("at", "candidate"))
    known = code.select("repo_id", F.col("path").alias("candidate"), F.col("file_id").alias("dst"))
    direct = tried.join(known, ["repo_id", "candidate"]).groupBy("repo_id", "src", "spec").agg(F.min_by("dst", "at").alias("dst"))
    direct = direct.checkpoint()
    rest = wanted.join(direct, ["repo_id", "src", "spec"], "left_anti").checkpoint()
    found = direct.select("repo_id", "src", "dst").unionByName(_by_package(code, rest)).unionByName(_by_suffix(code, rest)).unionByName(_by_include(code, rest)).unionByName(_by_crate(code, rest))
    return found.where(F.col("src") != F.col("dst")).distinct()


def _by_package(code: DataFrame, rest: DataFrame) -> DataFrame:
    """Go packages and wildcard imports: the directory whose path ends with the longest run of the spec."""
    dirs = code.select("repo_id", P.parent_dir(F.col("path")).alias("dir")).distinct()
    ends = dirs.select("repo_id", "dir", F.explode(P.dir_suffixes(F.col("dir"))).alias("suffix")).groupBy("repo_id", "suffix").agg(
        F.min(F.struct(F.length("dir").alias("n"), "dir")).alias("d")).select("repo_id", "suffix", F.col("d.dir").alias("dir"))
    go = rest.where((F.col("lang") == "Go") & F.col("spec").contains("/"))
    n = F.size(F.split("spec", "/"))
    runs = go.select("repo_id", "src", "spec", F.posexplode(F.slice(P.dir_suffixes(F.col("spec")), F.lit(1), n - 1)).alias("at", "suffix"))
    star = rest.where(F.col("lang").isin("Java", "Php", "Kotlin") & F.col("spec").rlike(r"[.\\]\*$"))
    whole = star.select("repo_id", "src", "spec", F.lit(0).alias("at"), F.regexp_replace(F.regexp_replace("spec", r"[.\\]\*$", ""), r"[.\\]", "/").alias("suffix"))
    best = runs.unionByName(whole).join(ends, ["repo_id", "suffix"]).groupBy("repo_id", "src", "spec").agg(F.min_by("dir", "at").alias("dir"))
    inside = code.select("repo_id", P.parent_dir(F.col("path")).alias("dir"), F.col("file_id").alias("dst"), "lang", "is_test")
    met = best.join(rest.select("repo_id", "src", "spec", F.col("lang").alias("from_lang")), ["repo_id", "src", "spec"]).join(inside, ["repo_id", "dir"])
    fit = met.where((F.col("from_lang") != "Go") | ((F.col("lang") == "Go") & ~F.col("is_test")))
    seen = Window.partitionBy("repo_id", "src", "spec").orderBy("dst")
    return fit.withColumn("rn", F.row_number().over(seen)).where(F.col("rn") <= PACKAGE_FILES).select("repo_id", "src", "dst")


def _by_suffix(code: DataFrame, rest: DataFrame) -> DataFrame:
    """Qualified names: Java-like ones by their longest run that ends a file's path, dotted Python ones by the nearest such file."""
    stem = F.regexp_replace(P.strip_ext(F.col("path")), "/__init__$", "")
    stems = code.select("repo_id", F.col("file_id").alias("dst"), "path", stem.alias("stem")).select(
        "repo_id", "dst", F.col("path").alias("dst_path"), "stem", F.explode(P.dir_suffixes(F.col("stem"))).alias("suffix"))
    clean = F.regexp_replace(F.regexp_replace(F.trim("spec"), r"^\\+|;+$", ""), r" as [\s\S]*$", "")
    parts = F.filter(F.split(clean, r"[.\\]"), lambda s: s != "")
    named = rest.where(F.col("lang").isin("Java", "Php", "Kotlin") & ~F.col("spec").endswith("*")).withColumn("ps", parts).where(F.size("ps") >= 2)
    runs = named.select("repo_id", "src", "spec", F.posexplode(F.slice(P.dir_suffixes(F.array_join("ps", "/")), F.lit(1), F.size("ps") - 1)).alias("at", "suffix"))
    met = runs.join(stems, ["repo_id", "suffix"])
    first = Window.partitionBy("repo_id", "src", "spec")
    exact = F.col("stem") == F.col("suffix")
    ranked = met.withColumn("rank", F.col("at") * 2 + F.when(exact, 0).otherwise(1)).withColumn("best", F.min("rank").over(first)).where(F.col("rank") == F.col("best"))
    one = ranked.withColumn("rn", F.row_number().over(first.orderBy("dst"))).where(exact | (F.col("rn") == 1)).select("repo_id", "src", "dst")
    dotted = rest.where((F.col("lang") == "Python") & F.col("spec").contains(".") & ~F.col("spec").startswith("."))
    by_name = dotted.withColumn("suffix", F.replace("spec", F.lit("."), F.lit("/"))).join(stems, ["repo_id", "suffix"])
    near = F.struct(P.common_prefix(F.col("path"), F.col("dst_path")).alias("n"), "dst")
    closest = by_name.groupBy("repo_id", "src", "spec").agg(F.max(near).alias("d")).select("repo_id", "src", F.col("d.dst").alias("dst"))
    return one.unionByName(closest)


def _by_include(code: DataFrame, rest: DataFrame) -> DataFrame:
    """Includes by name: of the files whose path ends with the spec, the nearest."""
    ends = code.select("repo_id", F.col("file_id").alias("dst"), F.col("path").alias("dst_path"), F.explode(P.dir_suffixes(F.col("path"))).alias("suffix"))
    wanted = rest.where(F.col("lang").isin("C", "Cpp")).withColumn("suffix", P.normalize(F.col("spec"))).join(ends, ["repo_id", "suffix"])
    near = F.struct(P.common_prefix(P.parent_dir(F.col("path")), F.col("dst_path")).alias("n"), "dst")
    return wanted.groupBy("repo_id", "src", "spec").agg(F.max(near).alias("d")).select("repo_id", "src", F.col("d.dst").alias("dst"))


def _by_crate(code: DataFrame, rest: DataFrame) -> DataFrame:
    """crate:: paths: below the nearest `src` above the file that has a lib.rs or main.rs."""
    roots = code.where(F.col("path").rlike(r"(^|/)src/(lib|main)\.rs$")).select("repo_id", P.parent_dir(F.col("path")).alias("root")).distinct()
    wanted = rest.where((F.col("lang") == "Rust") & F.col("spec").startswith("crate::")).withColumn("root", F.explode(_ancestors(P.parent_dir(F.col("path")))))
    base = wanted.join(roots, ["repo_id", "root"]).groupBy("repo_id", "src", "spec").agg(F.max_by("root", F.length("root")).alias("root"))
    head = F.regexp_replace(F.regexp_replace("spec", r"::\{[\s\S]*$", ""), r" as [\s\S]*$", "")
    after = F.slice(F.filter(F.split(head, "::"), lambda s: (s != "") & (s != "*")), F.lit(2), F.lit(64))
    both = lambda b: F.array(F.concat(b, F.lit(".rs")), F.concat(b, F.lit("/mod.rs")))
    deep = F.when(F.size(after) > 0, F.flatten(F.transform(F.sequence(F.size(after), F.lit(1), F.lit(-1)), lambda k: both(P.join(F.col("root"), F.array_join(F.slice(after, 1, k), "/")))))).otherwise(_none())
    tried = base.select("repo_id", "src", "spec", F.posexplode(F.concat(deep, F.array(P.join(F.col("root"), F.lit("lib.rs")), P.join(F.col("root"), F.lit("main.rs"))))).alias("at", "candidate"))
    known = code.select("repo_id", F.col("path").alias("candidate"), F.col("file_id").alias("dst"))
    return tried.join(known, ["repo_id", "candidate"]).groupBy("repo_id", "src", "spec").agg(F.min_by("dst", "at").alias("dst")).select("repo_id", "src", "dst")


def resolve_calls(files: DataFrame, symbols: DataFrame, calls: DataFrame, file_imports: DataFrame) -> DataFrame:
    """(repo_id, file_id, caller, target, target_file, kind, line, ord, n): what each call means, at most three symbols.

    Calls that cannot differ in their target (same file, caller, name, qualifier and form) are resolved once;
    line and ord are those of the first, n is how many there are.  The first rule with a candidate decides:
    member calls: through this or self, the same owner in the file, else the file; the qualifier as owner, near
    ones (same file or imported) before all; the file; imported files, if at most three; a unique name of four
    letters or more that is not generic.  Others: the file; imported files; a unique name; the directory, if
    one, or at most three where a directory is a package.
    """
    same = ["repo_id", "file_id", "from_symbol", "name", "heritage", "qual", "is_member"]
    once = calls.groupBy(*same).agg(F.min("call_id").alias("call_id"), F.min_by("line", "call_id").alias("line"), F.count("*").alias("n"))
    by_name = symbols.select("repo_id", F.col("symbol_id").alias("target"), F.col("file_id").alias("target_file"), "name", "kind", "owner")
    rare = symbols.groupBy("repo_id", "name").agg(F.count("*").alias("c")).where(F.col("c") <= MOST_CANDIDATES).select("repo_id", "name")
    met = once.join(by_name.join(rare, ["repo_id", "name"]), ["repo_id", "name"])
    kinds = F.when(F.col("heritage"), F.col("kind").isin(*CONTAINERS)).otherwise(F.col("kind").isin(*CALLABLE))
    met = met.where(kinds & ~F.col("target").eqNullSafe(F.col("from_symbol")))
    where = files.select(F.col("file_id"), P.parent_dir(F.col("path")).alias("dir"), "lang")
    there = files.select(F.col("file_id").alias("target_file"), P.parent_dir(F.col("path")).alias("target_dir"))
    owners = symbols.select(F.col("symbol_id").alias("from_symbol"), F.col("owner").alias("caller_owner"))
    linked = file_imports.select("repo_id", F.col("src").alias("file_id"), F.col("dst").alias("target_file"), F.lit(True).alias("imported"))
    full = met.join(where, "file_id").join(there, "target_file").join(owners, "from_symbol", "left").join(linked, ["repo_id", "file_id", "target_file"], "left")
    local, imported = F.col("file_id") == F.col("target_file"), F.coalesce("imported", F.lit(False))
    qual = F.coalesce("qual", F.lit(""))
    by_self = qual.isin(*SELF_NAMES)
    owned = F.col("owner").eqNullSafe(F.col("caller_owner"))
    of_qual = (qual != "") & F.coalesce(F.col("owner") == qual, F.lit(False))
    near_dir = F.col("dir") == F.col("target_dir")
    call = Window.partitionBy("call_id")
    count = lambda c: F.count_if(c).over(call)
    n_all = F.count("*").over(call)
    # The rule that each candidate would be chosen by; the call's first rule wins.
    member = (
        F.when(by_self, F.when(local & owned, 1).when(local, 2)).when(of_qual & (local | imported), 3).when(of_qual, 4).when(local, 5)
        .when(imported & (count(imported) <= 3), 6).when((n_all == 1) & (F.length("name") >= 4) & ~F.col("name").isin(*GENERIC_METHODS), 7))
    few = (count(near_dir) == 1) | (F.col("lang").isin(*SAME_PACKAGE) & (count(near_dir) <= 3))
    other = F.when(local, 1).when(imported, 2).when(n_all == 1, 3).when(near_dir & few, 4)
    # Through this or self nothing else counts, so a candidate elsewhere must not either.
    ruled = full.withColumn("rule", F.when(F.col("is_member"), member).otherwise(other))
    ruled = ruled.withColumn("first", F.min("rule").over(call)).where(F.col("rule") == F.col("first"))
    kept = ruled.withColumn("at", F.row_number().over(call.orderBy("target"))).where(F.col("at") <= MOST_TARGETS)
    return kept.select(
        "repo_id", "file_id", F.col("from_symbol").alias("caller"), "target", "target_file", F.when(F.col("heritage"), "Extends").otherwise("Calls").alias("kind"),
        "line", (F.col("call_id") * 4 + F.col("at")).alias("ord"), "n")


def symbol_edges(resolved: DataFrame) -> DataFrame:
    """(repo_id, src, dst, kind, line, ord): one edge per caller and target, of their first call, whatever its kind."""
    first = F.min(F.struct("ord", "kind", "line")).alias("e")
    return resolved.where(F.col("caller").isNotNull()).groupBy("repo_id", F.col("caller").alias("src"), F.col("target").alias("dst")).agg(first).select(
        "repo_id", "src", "dst", "e.kind", "e.line", "e.ord")


def file_edges(resolved: DataFrame, file_imports: DataFrame) -> DataFrame:
    """(repo_id, src, dst, imports, calls, weight): imports count 0 or 1, calls each; weight = imports + calls/2."""
    called = resolved.where(F.col("file_id") != F.col("target_file")).select("repo_id", F.col("file_id").alias("src"), F.col("target_file").alias("dst"), F.lit(0).alias("i"), F.col("n").alias("c"))
    both = called.unionByName(file_imports.select("repo_id", "src", "dst", F.lit(1).alias("i"), F.lit(0).cast("long").alias("c")))
    summed = both.groupBy("repo_id", "src", "dst").agg(F.max("i").alias("imports"), F.sum("c").alias("calls"))
    return summed.withColumn("weight", F.col("imports") + F.col("calls") * 0.5)


# Lines of a file whose intervals and positions meet in one bucket.
_BUCKET = 256


def innermost(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """`points` (file_id, line, and more) with symbol_id: the shortest symbol that spans the line, else null.

    Symbols and points meet per file and bucket of lines; of equally short ones the smaller id counts.
    """
    spans = symbols.where(F.col("end_line") >= F.col("start_line")).select("file_id", "symbol_id", "start_line", "end_line").withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("start_line") / _BUCKET), F.floor(F.col("end_line") / _BUCKET))))
    keyed = points.withColumn("bucket", F.floor(F.col("line") / _BUCKET))
    met = keyed.select("file_id", "line", "bucket").distinct().join(spans, ["file_id", "bucket"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = met.groupBy("file_id", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "symbol_id")).alias("s"))
    return points.join(best.select("file_id", "line", F.col("s.symbol_id").alias("symbol_id")), ["file_id", "line"], "left")


def overlapping(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, first, last, symbol_id): symbols, containers left out, that changed lines touch; null for the file itself."""
    inner = symbols.where(~F.col("kind").isin(*CONTAINERS) & (F.col("end_line") >= F.col("start_line"))).select("file_id", "symbol_id", "start_line", "end_line")
    spans = inner.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / _BUCKET), F.floor(F.col("end_line") / _BUCKET))))
    asked = hunks.where(F.col("last") >= F.col("first")).select("file_id", "first", "last").distinct()
    keyed = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / _BUCKET), F.floor(F.col("last") / _BUCKET))))
    hits = keyed.join(spans, ["file_id", "bucket"]).where((F.col("first") <= F.col("end_line")) & (F.col("last") >= F.col("start_line"))).select("file_id", "first", "last", "symbol_id").distinct()
    return asked.join(hits, ["file_id", "first", "last"], "left")


def changed_targets(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, node): the symbols that changed lines stand for: those they touch, or, if none, all of the file.

    hunks: query_id, file_id, first, last; the lines of a file that is changed as a whole are those from its first on.
    """
    touched = overlapping(hunks, symbols)
    asked = hunks.select("query_id", "file_id", "first", "last").distinct().join(touched, ["file_id", "first", "last"])
    own = asked.where("symbol_id IS NOT NULL").select("query_id", F.col("symbol_id").alias("node"))
    whole = asked.where("symbol_id IS NULL").select("query_id", "file_id").distinct().join(symbols.select("file_id", F.col("symbol_id").alias("node")), "file_id").select("query_id", "node")
    return own.unionByName(whole).distinct()


def resolve_targets(queries: DataFrame, files: DataFrame, symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """(query, at, file_id, symbol_id): what names and paths mean; at 0 is the best, 1..5 are alternatives.

    queries: query.  In order: `path:line` (the innermost symbol, else the file), an exact path, the only path
    that ends so, `Owner.name`, a name, a name in any case.  Symbols of files that are not tests come first,
    then by rank, then by id.
    """
    asked = queries.select("query", F.regexp_replace(F.trim("query"), r"^(\./)+", "").alias("q")).where("q <> ''").distinct()
    with_line = asked.select("query", "q", F.regexp_extract("q", r"^(.*):(\d+)$", 1).alias("p"), F.regexp_extract("q", r"^(.*):(\d+)$", 2).alias("l"))
    asked_paths = with_line.select("query", F.when(F.col("l") != "", F.col("p")).otherwise(F.col("q")).alias("p"), F.when(F.col("l") != "", F.col("l").cast("int")).alias("line"))
    ends = files.select("file_id", "path", F.explode(P.dir_suffixes(F.col("path"))).alias("p"))
    met = asked_paths.join(ends, "p")
    whole = F.col("path") == F.col("p")
    per = Window.partitionBy("query")
    chosen = met.withColumn("exact", F.max(whole.cast("int")).over(per)).withColumn("n", F.count("*").over(per)).where(
        ((F.col("exact") == 1) & whole) | ((F.col("exact") == 0) & (F.col("n") == 1) & F.col("p").rlike("[./]")))
    chosen = chosen.groupBy("query", "line").agg(F.min("file_id").alias("file_id"))
    located = innermost(chosen, symbols).select("query", F.lit(0).alias("at"), "file_id", "symbol_id")
    parts = F.filter(F.split("q", "[.#:]"), lambda s: s != "")
    names = asked.join(located.select("query"), "query", "left_anti").withColumn("ps", parts).where(F.size("ps") > 0).select(
        "query", F.element_at("ps", -1).alias("name"), F.when(F.size("ps") > 1, F.element_at("ps", F.when(F.size("ps") > 1, -2).otherwise(-1))).alias("owner"))
    low = names.withColumn("low", F.lower("name"))
    known = symbols.select("symbol_id", "file_id", F.col("name").alias("known"), F.lower("name").alias("low"), F.col("owner").alias("known_owner"))
    hits = low.join(known, "low")
    tier = F.when((F.col("name") == F.col("known")) & (F.col("owner") == F.col("known_owner")), 0).when(F.col("name") == F.col("known"), 1).otherwise(2)
    best = hits.withColumn("tier", tier).withColumn("top", F.min("tier").over(per)).where(F.col("tier") == F.col("top"))
    order = best.join(files.select("file_id", "is_test"), "file_id").join(ranks.select("symbol_id", "rank"), "symbol_id", "left")
    placed = order.withColumn("at", F.row_number().over(per.orderBy("is_test", F.coalesce("rank", F.lit(0.0)).desc(), "symbol_id")) - 1).where("at <= 5")
    return located.unionByName(placed.select("query", "at", "file_id", "symbol_id"))
