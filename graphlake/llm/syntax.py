"""Source files that are no valid text of the language their path names, by packrat parsing."""

from __future__ import annotations

import gc
import re
import sys
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.grammars import BAD, CONFLICT, Language, language_of
from graphlake.llm.shards import shared_folder
from graphlake.sources.tables import latest, table

EXTENSIONS = ("py", "js", "mjs", "jsx", "ts", "go", "rs", "java", "c")

# Depth of nested calls that a parse may take, and the stack that holds it.
_DEPTH, _STACK = 60_000, 512 * 1024 * 1024

_SCHEMA = "file_id long, valid boolean, line int, cause string"


_F_PREFIX = re.compile(r"[fF][rR]?[\"']")
_F_STRING = re.compile(r"(?i)(f|fr|rf)(\"\"\"|\'\'\'|\"|\')")


def _field(language: Language, text: str, at: int, python: bool) -> tuple[int, str | None]:
    """(end, expression) of the field of a string that begins at `at`, after its opening brace; no expression if it doesn't end."""
    depth, begin = 0, at
    while at < len(text):
        token = language.lexer.match(text, at).group()
        if depth == 0:
            follows = token in ("!", ":", ":=") or (token == "=" and re.match(r"\s*[}!:]", text[at + 1 :]))
            if token == "}" or (python and follows):
                return at, text[begin:at]
        # A sign together with the regular expression after it counts by the sign.
        depth += (token[:1] in "([{") - (token in (")", "]", "}"))
        if depth < 0:
            return at, None
        at += len(token)
    return at, None


def _fields(language: Language, token: str) -> Iterator[tuple[int, str | None]]:
    """(place, expression) of the fields of a template or formatted string; none of other tokens."""
    formatted = _F_STRING.match(token) if language.name == "Python" else None
    if formatted is None and not (language.name != "Python" and token[:1] == "`"):
        return
    raw = formatted is not None and "r" in formatted.group(1).lower()
    at, end = (formatted.end(), len(token) - len(formatted.group(2))) if formatted else (1, len(token) - 1)
    nested = 0
    while at < end:
        two = token[at : at + 2]
        if formatted is None:
            if two == "${":
                stop, inner = _field(language, token, at + 2, False)
                yield at, inner
                at = stop + 1
            else:
                at += 2 if token[at] == "\\" else 1
        elif token[at] == "\\" and not raw:
            name = re.compile(r"N\{[^{}]*\}").match(token, at + 1)
            at = name.end() if name else at + 1 if token[at + 1] in "{}" else at + 2
        elif token[at] == "{" and (two != "{{" or nested):
            stop, inner = _field(language, token, at + 1, True)
            yield at, inner
            if inner is None:
                return
            tail = re.compile(r"=?\s*(?:![^\W\d]\w*\s*)?([:}])").match(token, stop)
            if tail is None:
                yield stop, None
                return
            nested += tail.group(1) == ":"
            at = tail.end()
        elif token[at] == "}" and nested:
            nested -= 1
            at += 1
        else:
            at += 2 if two == "{{" else 1


def _bad_field(language: Language, tokens: list[str]) -> int | None:
    """The line of the first field of a template or formatted string that holds no expression."""
    # Strings with fields are few: lines are counted only where one is faulty.
    for k in [k for k, token in enumerate(tokens) if len(token) > 2 and "{" in token]:
        token = tokens[k]
        for at, inner in _fields(language, token):
            # Brackets balance within a field, so the parentheses around it are a pair.
            deeper = None
            if inner is not None:
                kinds, parts, _ = language.read(f"({inner}\n)\n" if language.name == "Python" else f"({inner}\n);")
                if inner.strip() and _matches(language, kinds)[0]:
                    deeper = _bad_field(language, parts)
                    if deeper is None:
                        continue
            return 1 + sum(t.count("\n") for t in tokens[:k]) + token.count("\n", 0, at) + (deeper - 1 if deeper else 0)
    return None


def _matches(language: Language, kinds: str) -> tuple[bool, int]:
    """(whether the grammar takes in all kinds, the furthest position refused)."""
    try:
        return (True, 0) if language.grammar.matches(kinds) else (False, language.grammar.furthest(kinds))
    except RecursionError:
        return language.grammar.deep(kinds)


# An element can begin where an expression can: after these signs and words, or at the start.
_ELEMENT = re.compile(r"<(?=[A-Za-z_$>])")
_BEFORE = re.compile(r"(?:^|[(,=?:&|\[{};>!]|\b(?:return|default|case|yield|await))\s*\Z")
_OPEN = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?\s*")
_ATTRIBUTE = re.compile(r"([A-Za-z_$][\w$:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'))?\s*")
_CLOSE = re.compile(r"<\s*/\s*([A-Za-z_$][\w$.:-]*)?\s*>")


def plain_script(text: str) -> tuple[str, int | None]:
    """(the text with every JSX element as an array of the expressions in it, None), or (the text, line of a faulty element).

    Lines stay where they are.  Elements within the expressions of elements are replaced in the same way.
    """
    language = language_of("js")
    out: list[str] = []
    used: set[int] = set()  # parentheses of the script itself, and of expressions that have ended
    # What is open: the name of an element within its tags, or the depth of brackets within an expression.
    open_: list[tuple[str, object]] = []
    at, depth = 0, 0

    def fail() -> tuple[str, int]:
        return text, 1 + text.count("\n", 0, at)

    def tag() -> bool:
        """Reads attributes up to the end of a tag, or to an expression among them."""
        nonlocal at
        while at < len(text):
            if text.startswith("/>", at):
                at += 2
                open_.pop()
                out.append("]")
                return True
            if text[at] == ">":
                at += 1
                open_[-1] = ("inner", open_[-1][1])
                return True
            if text[at] == "{":
                return expression()
            m = _ATTRIBUTE.match(text, at)
            if not m:
                return False
            out.append("\n" * m.group().count("\n"))
            at = m.end()
            if text.startswith("=", at):
                gap = re.compile(r"=\s*").match(text, at)
                out.append("\n" * gap.group().count("\n"))
                at = gap.end()
                if not text.startswith("{", at):
                    return False
        return False

    def expression() -> bool:
        nonlocal at, depth
        open_.append(("code", depth))
        depth = 0
        at += 1
        out.append("(")
        return True

    while at < len(text):
        kind = open_[-1][0] if open_ else "code"
        if kind == "tag":
            space = re.compile(r"\s*").match(text, at)
            out.append("\n" * space.group().count("\n"))
            at = space.end()
            if not tag():
                return fail()
        elif kind == "inner":
            closing = _CLOSE.match(text, at)
            if closing:
                if (closing.group(1) or "") != open_[-1][1]:
                    return fail()
                open_.pop()
                out.append("\n" * closing.group().count("\n") + "]")
                at = closing.end()
            elif text[at] == "<":
                begun = _OPEN.match(text, at)
                out.append("[")
                open_.append(("tag", begun.group(1) or ""))
                at = begun.end()
            elif text[at] == "{":
                expression()
            elif text[at] in ">}":
                return fail()
            else:
                out.append("\n" if text[at] == "\n" else "")
                at += 1
        elif text[at] == "<" and _ELEMENT.match(text, at) and _BEFORE.search("".join(out[-12:])[-40:]):
            begun = _OPEN.match(text, at)
            out.append("[")
            open_.append(("tag", begun.group(1) or ""))
            at = begun.end()
        else:
            token = language.lexer.match(text, at).group()
            if token == "}" and open_ and depth == 0:
                _, depth = open_.pop()
                # An expression within an element is one part of its array; an empty one, or a comment, is none.
                begin = max(k for k, part in enumerate(out) if part == "(" and k not in used)
                used.add(begin)
                inner = "".join(out[begin + 1 :])
                kinds, _, _ = language.read(inner)
                out[begin] = "" if not kinds.strip("N") else "(" if not inner.lstrip().startswith("...") else "["
                out.append("" if out[begin] == "" else (")," if out[begin] == "(" else "],"))
            else:
                depth += (token[:1] in ("{", "(", "[")) - (token in ("}", ")", "]"))
                if token == "(":
                    used.add(len(out))
                out.append(token)
            at += len(token)
    return ("".join(out), None) if not open_ else fail()


def parse(text: str, extension: str) -> tuple[bool, int | None, str | None]:
    """(valid, line of the furthest failure, cause) of a text in the language of an extension.

    An empty text is valid in every language but Go, which wants a package clause.  Causes: 'conflict' for
    merge-conflict markers, 'truncated' when the text ends too early, 'character' for what no token can begin
    with, else 'unexpected'.  A text nested too deep for the stack is parsed again with a stack on the heap.
    """
    language = language_of(extension)
    if language is None:
        return True, None, None
    text = text.removeprefix("\ufeff")
    if extension == "jsx" and _ELEMENT.search(text):
        text, bad = plain_script(text)
        if bad is not None:
            return False, bad, "unexpected"
    kinds, tokens, _ = language.read_quick(text)
    valid, far = _matches(language, kinds)
    if valid:
        fields = _F_PREFIX.search(text) if language.name == "Python" else "${" in text and language.name in ("JavaScript", "TypeScript")
        bad = _bad_field(language, tokens) if fields else None
        return (True, None, None) if bad is None else (False, bad, "unexpected")
    _, tokens, where = language.read(text)
    at = where.after(kinds, far)
    line = 1 + sum(t.count("\n") for t in tokens[:at])
    if CONFLICT in kinds:
        cause = "conflict"
    elif not kinds[far:].strip("ND"):
        cause = "truncated"
    elif BAD in kinds[far : far + 1]:
        cause = "character"
    else:
        cause = "unexpected"
    return False, line, cause


def _deep(work):
    """The result of `work` on a thread with a large stack."""
    out: list = []
    errors: list[BaseException] = []

    def run() -> None:
        try:
            out.append(work())
        except BaseException as error:  # noqa: BLE001 - raised again below, by the thread that asked
            errors.append(error)

    old = threading.stack_size(_STACK)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(_DEPTH)
    try:
        t = threading.Thread(target=run)
        t.start()
        t.join()
    finally:
        threading.stack_size(old)
        sys.setrecursionlimit(limit)
    if errors:
        raise errors[0]
    return out[0]


def _uncollected(work):
    """The result of `work` without runs of the collector of circles, for which parses leave nothing."""
    running = gc.isenabled()
    gc.disable()
    try:
        return work()
    finally:
        if running:
            gc.enable()


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = _uncollected(lambda b=batch: _deep(lambda: [(f, *parse(t, e)) for f, e, t in zip(b["file_id"], b["ext"], b["content"], strict=True)]))
        yield pd.DataFrame(rows, columns=["file_id", "valid", "line", "cause"]).astype({"line": "Int32"})


def extension(path: Column) -> Column:
    """The extension of a path in lower case, '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parsed(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, repo_id, ext, valid, line, cause) of every file with a text in a language that can be parsed.

    files: file_id, repo_id, path, indexed_at.  texts: file_id, content.  The extension of the path decides on
    the language; other files, null texts, null ids and null paths have no row; repeated rows count once.
    """
    one = latest(files, "file_id", ["repo_id", "path"], "indexed_at").where(F.col("path").isNotNull())
    code = one.select(F.col("file_id").cast("long").alias("file_id"), "repo_id", extension(F.col("path")).alias("ext")).where(F.col("ext").isin(*EXTENSIONS))
    full = texts.where(F.col("file_id").isNotNull() & F.col("content").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "content")
    # The texts go to their files by id, once each; a hot repository is only many ids.
    once = full.join(code, "file_id").dropDuplicates(["file_id"])
    checked = once.select("file_id", "ext", "content").mapInPandas(_parse_all, _SCHEMA)
    return checked.join(code, "file_id").select("file_id", "repo_id", "ext", "valid", "line", "cause")


def invalid_rates(checked: DataFrame) -> DataFrame:
    """(repo_id, ext, n_files, n_invalid, n_conflicts, rate) by repository and language."""
    bad = ~F.col("valid")
    return checked.groupBy("repo_id", "ext").agg(
        F.count("*").alias("n_files"), F.count_if(bad).alias("n_invalid"), F.count_if(F.col("cause") == "conflict").alias("n_conflicts"),
    ).withColumn("rate", F.col("n_invalid") / F.col("n_files"))


def _checked(spark: SparkSession, directory: str) -> DataFrame:
    shared_folder(spark)
    return parsed(table(spark, directory, "files"), table(spark, directory, "file_texts"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Files that are syntactically invalid."""
    return _checked(spark, directory).where(~F.col("valid")).select(F.col("file_id").cast("int").alias("file_id"))


def p5_failures(spark: SparkSession, directory: str) -> DataFrame:
    """The same with the line of the furthest failure and its cause."""
    return _checked(spark, directory).where(~F.col("valid")).select(F.col("file_id").cast("int").alias("file_id"), "repo_id", "ext", "line", "cause")


def p5_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Shares of invalid files by repository and language."""
    return invalid_rates(_checked(spark, directory))


QUERIES = {"p5_found": p5_found, "p5_failures": p5_failures, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
