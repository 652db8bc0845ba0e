"""Facts from source texts: definitions, calls, imports and chunks, one row per file with nested arrays.

Python is read with its own parser; where that refuses a file, and for other languages, definitions are found
line by line in the text without strings and comments, and their ends by matching braces or indentation.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINERS = ("class", "struct", "interface", "trait", "enum", "module")
CHUNK_LINES, WINDOW_LINES, HEADER_LINES, SIGNATURE = 150, 60, 40, 160

FACTS = (
    "repo_id string, file_id long, symbols array<struct<at:int,name:string,kind:string,start_line:int,end_line:int,owner:string,parent:int,signature:string>>, "
    "calls array<struct<name:string,line:int,from_symbol:int,heritage:boolean,qual:string,is_member:boolean>>, imports array<string>, chunks array<struct<start_line:int,end_line:int,symbol:int>>")

_MASK = {
    "hash": re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*", re.S),
    "slash": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.[^'\n]*)'", re.S)}
_NAME = r"([A-Za-z_$][\w$]*)"
# For each language: what a line that begins a definition looks like, and its kind.
_JS = [
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+" + _NAME, "class"), (r"^\s*(?:export\s+)?interface\s+" + _NAME, "interface"),
    (r"^\s*(?:export\s+)?(?:const\s+)?enum\s+" + _NAME, "enum"), (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*" + _NAME, "function"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+" + _NAME + r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::\s*[^=]+)?=>", "function"),
    (r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)" + _NAME + r"\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^;{]+)?\{", "method")]
_CS = r"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|extern|unsafe|readonly|new|file)\s+)*"
_KT = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|open|abstract|sealed|final|data|enum|annotation|inner|value|inline|override|suspend|operator|infix|tailrec|external|companion|expect|actual|const|lateinit)\s+)*"
_SW = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final|static|class|override|mutating|nonmutating|required|convenience|indirect|async|isolated|nonisolated|prefix|postfix)\s+)*"
_DEFINITIONS = {
    "JavaScript": _JS, "TypeScript": _JS, "Tsx": _JS,
    "Python": [(r"^\s*class\s+" + _NAME, "class"), (r"^\s*(?:async\s+)?def\s+" + _NAME, "function")],
    "Go": [(r"^func\s+\(\s*\w*\s*\*?\s*(?P<owner>\w+)[^)]*\)\s*" + _NAME, "method"), (r"^func\s+" + _NAME, "function"), (r"^type\s+" + _NAME + r"\s+struct\b", "struct"), (r"^type\s+" + _NAME + r"\s+interface\b", "interface")],
    "Rust": [
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+" + _NAME, "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+" + _NAME, "enum"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+" + _NAME, "trait"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+" + _NAME + r"\s*\{", "module"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+" + _NAME, "function"), (r"^\s*macro_rules!\s*" + _NAME, "macro")],
    "Java": [
        (r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+" + _NAME, "class"), (r"^\s*(?:(?:public|private|protected|static)\s+)*@?interface\s+" + _NAME, "interface"),
        (r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+" + _NAME, "enum"),
        (r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?!return\b|new\b|else\b|throw\b)[\w<>\[\], ?.]+\s+(?!if\b|for\b|while\b|switch\b|catch\b)" + _NAME + r"\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{", "method")],
    "C": [(r"^(?:typedef\s+)?struct\s+" + _NAME + r"\s*\{", "struct"), (r"^(?:typedef\s+)?enum\s+" + _NAME + r"\s*\{", "enum"), (r"^(?!return\b|else\b|typedef\b|#)[A-Za-z_][\w\s*]*?[\s*]" + _NAME + r"\s*\([^;]*\)\s*(?:\{|$)", "function")],
    "CSharp": [
        (_CS + r"namespace\s+([\w.]+)\s*(?:\{|$)", "module"), (_CS + r"(?:class|record(?:\s+class)?)\s+" + _NAME, "class"), (_CS + r"(?:record\s+)?struct\s+" + _NAME, "struct"), (_CS + r"interface\s+" + _NAME, "interface"), (_CS + r"enum\s+" + _NAME, "enum"),
        (r"^\s+" + _CS[1:] + r"(?!return\b|new\b|else\b|throw\b|await\b|using\b|yield\b)(?:[\w<>\[\],?.]+\s+)?(?!if\b|for\b|foreach\b|while\b|switch\b|catch\b|lock\b|using\b)" + _NAME + r"\s*(?:<[^>()]*>)?\([^;]*\)\s*(?:where [^{]+|:\s*(?:base|this)\b[^{]*)?(?:\{.*|=>.*)?$", "method")],
    "Ruby": [(r"^\s*class\s+(?:\w+::)*" + _NAME, "class"), (r"^\s*module\s+(?:\w+::)*" + _NAME, "module"), (r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", "method")],
    "Php": [
        (r"^\s*(?:(?:abstract|final|readonly)\s+)*class\s+" + _NAME, "class"), (r"^\s*interface\s+" + _NAME, "interface"), (r"^\s*trait\s+" + _NAME, "trait"), (r"^\s*enum\s+" + _NAME, "enum"),
        (r"^\s*(?:(?:abstract|final|public|private|protected|static)\s+)+function\s+&?\s*" + _NAME, "method"), (r"^\s*function\s+&?\s*" + _NAME, "function")],
    "Kotlin": [
        (_KT + r"(?:class|object)\s+" + _NAME, "class"), (_KT + r"(?:fun\s+)?interface\s+" + _NAME, "interface"), (_KT + r"fun\s+(?:<[^>]*>\s*)?(?:(?P<owner>\w+)(?:<[^>]*>)?\??\.)?`?" + _NAME, "function")],
    "Swift": [
        (_SW + r"(?:class(?!\s+func)|actor)\s+" + _NAME, "class"), (_SW + r"struct\s+" + _NAME, "struct"), (_SW + r"protocol\s+" + _NAME, "interface"), (_SW + r"enum\s+" + _NAME, "enum"),
        (_SW + r"func\s+" + _NAME, "function"), (_SW + r"(init)[?!]?\s*(?:<[^>]*>)?\(", "method")]}
_COMPILED = {k: [(re.compile(p), kind) for p, kind in v] for k, v in _DEFINITIONS.items()}
_CALL = re.compile(r"(?:([\w$]+)?\s*(\.|->|::)\s*)?([A-Za-z_$][\w$]*)!?\s*\(")
_NO_CALL = frozenset("if for while switch catch return function def class match when elif with and or not in is lambda sizeof fn func typeof new await throw super constructor".split())
_IMPORTS = {
    "JavaScript": re.compile(r"""(?:^|\n)\s*(?:import|export)\b[^;\n]*?["']([^"'\n]+)["']|\brequire\(\s*["']([^"'\n]+)["']"""), "Go": re.compile(r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$', re.M),
    "Rust": re.compile(r"^\s*(?:pub\s+)?use\s+([^;]+);", re.M), "Java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M), "C": re.compile(r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]', re.M)}
_IMPORTS |= {
    "CSharp": re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", re.M), "Ruby": re.compile(r"""^\s*require(?:_relative)?\s*\(?\s*["']([^"'\n]+)["']""", re.M),
    "Php": re.compile(r"""^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?["']([^"'\n]+)["']""", re.M),
    "Kotlin": re.compile(r"^\s*import\s+([\w.*]+)", re.M), "Swift": re.compile(r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?([\w.]+)", re.M)}
_IMPORTS["TypeScript"] = _IMPORTS["Tsx"] = _IMPORTS["JavaScript"]
_HERITAGE = {
    "JavaScript": re.compile(r"\bclass\s+\w+\s+extends\s+([\w.$]+)"), "Java": re.compile(r"\b(?:extends|implements)\s+([\w., <>]+)"), "Rust": re.compile(r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b")}
_HERITAGE |= {
    "CSharp": re.compile(r"\b(?:class|struct|interface|record)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*([\w., <>]+)"), "Ruby": re.compile(r"\bclass\s+[\w:]+\s*<\s*([\w:]+)"),
    "Php": re.compile(r"\b(?:extends|implements)\s+([\w\\, ]+)"), "Kotlin": re.compile(r"\b(?:class|object|interface)\s+\w+(?:<[^>]*>)?(?:\s*\([^)]*\))?\s*:\s*([\w., <>]+)"),
    "Swift": re.compile(r"\b(?:class|struct|enum|protocol|actor|extension)\s+[\w.]+(?:<[^>]*>)?\s*:\s*([\w., <>&]+)")}
_HERITAGE["TypeScript"] = _HERITAGE["Tsx"] = re.compile(r"\b(?:extends|implements)\s+([\w.,$ ]+)")


def clean_import(spec: str) -> str:
    """A spec without quotes and angle brackets."""
    return spec.strip().strip("\"'`<>;").strip()


def qualifier(receiver: str) -> str:
    """The last part of a receiver; '' for anything that is no path of names."""
    return re.split(r"\.|::|->", receiver)[-1] if re.fullmatch(r"[\w$]+(?:(?:\.|::|->)[\w$]+)*", receiver) else ""


def nest(found: list[dict], scopes: list[tuple[int, int, str]]) -> list[dict]:
    """Definitions in order with their parents and owners; repeated ones at one place dropped; owned functions become methods.

    An owner is told by the definition, else it is the enclosing container, else the innermost scope of an implementation.
    """
    found = sorted(found, key=lambda d: (d["start_line"], -d["end_line"]))
    out: list[dict] = []
    stack: list[int] = []
    for d in found:
        if out and out[-1]["start_line"] == d["start_line"] and out[-1]["name"] == d["name"]:
            continue
        while stack and out[stack[-1]]["end_line"] < d["start_line"]:
            stack.pop()
        parent = stack[-1] if stack else None
        owner = d.get("owner")
        inside = parent is not None and out[parent]["kind"] in CONTAINERS
        if owner is None and inside:
            owner = out[parent]["name"]
        if owner is None:
            around = [(e - s, o) for s, e, o in scopes if s <= d["start_line"] and d["end_line"] <= e]
            owner = min(around)[1] if around else None
        kind = "method" if d["kind"] == "function" and owner is not None and (parent is None or inside) else d["kind"]
        out.append({**d, "at": len(out), "kind": kind, "owner": owner, "parent": parent})
        stack.append(len(out) - 1)
    return out


def chunk(symbols: list[dict], lines: list[str]) -> list[dict]:
    """Line ranges that cover a file: small definitions whole, large ones as a header and their parts, the rest in windows."""
    n = len(lines)
    children: dict[int | None, list[int]] = {}
    for s in symbols:
        children.setdefault(s["parent"], []).append(s["at"])
    out, covered = [], bytearray(n + 2)
    work = list(children.get(None, []))
    while work:
        i = work.pop()
        s = symbols[i]
        below = children.get(i, [])
        if s["end_line"] - s["start_line"] + 1 <= CHUNK_LINES or not below:
            end = min(s["end_line"], s["start_line"] + 2 * CHUNK_LINES)
        else:
            end = min(max(min(symbols[c]["start_line"] for c in below) - 1, s["start_line"]), s["start_line"] + HEADER_LINES)
            work += below
        out.append((s["start_line"], end, i))
        covered[s["start_line"] : end + 1] = b"\1" * (min(end, n) - s["start_line"] + 1)
    at = 1
    while at <= n:
        if covered[at]:
            at += 1
            continue
        end = at
        while end < n and not covered[end + 1] and end - at + 1 < WINDOW_LINES:
            end += 1
        out.append((at, end, None))
        at = end + 1
    kept = [(a, b, s) for a, b, s in out if re.search(r"\w", "\n".join(lines[a - 1 : b]))]
    return [{"start_line": a, "end_line": b, "symbol": s} for a, b, s in sorted(kept, key=lambda c: (c[0], c[1]))]


def _caller(spans: list[dict], line: int) -> int | None:
    """The innermost definition around a line."""
    around = [(s["end_line"] - s["start_line"], -s["at"]) for s in spans if s["start_line"] <= line <= s["end_line"]]
    return -min(around)[1] if around else None


def _python(tree: ast.Module, lines: list[str]) -> tuple[list[dict], list[dict], list[str]]:
    found, calls, imports = [], [], []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append({"name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "start_line": node.lineno, "end_line": node.end_lineno or node.lineno, "signature": lines[node.lineno - 1].strip()[:SIGNATURE]})
            for base in getattr(node, "bases", []):
                name = ast.unparse(base).split(".")[-1]
                if name.isidentifier():
                    calls.append((name, base.lineno, True, None, False))
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                calls.append((node.func.id, node.lineno, False, None, False))
            elif isinstance(node.func, ast.Attribute):
                calls.append((node.func.attr, node.lineno, False, qualifier(ast.unparse(node.func.value)), True))
        elif isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
    return found, calls, imports


def _end(masked: list[str], first: int, lang: str) -> int:
    """The last line of the definition that begins on line `first` (0-based), by indentation or braces."""
    if lang == "Python":
        indent = len(masked[first]) - len(masked[first].lstrip())
        last = first
        for k in range(first + 1, len(masked)):
            if masked[k].strip():
                if len(masked[k]) - len(masked[k].lstrip()) <= indent:
                    break
                last = k
        return last
    if lang == "Ruby":
        indent = len(masked[first]) - len(masked[first].lstrip())
        if re.search(r"\bend\s*$", masked[first]):
            return first
        return next((k for k in range(first + 1, len(masked)) if re.match(r"\s{%d}end\b" % indent, masked[k])), len(masked) - 1)
    if lang in ("Kotlin", "Swift") and "{" not in masked[first]:
        # No body, or an expression: it ends where the parentheses of its head do, unless the next line opens a body.
        depth = 0
        for k in range(first, len(masked)):
            depth += masked[k].count("(") - masked[k].count(")")
            if depth <= 0 and "{" not in masked[k]:
                return k if not masked[k + 1 : k + 2] or not masked[k + 1].lstrip().startswith("{") else _braces(masked, k + 1)
            if "{" in masked[k]:
                return _braces(masked, k)
    return _braces(masked, first)


def _braces(masked: list[str], first: int) -> int:
    depth, opened = 0, False
    for k in range(first, len(masked)):
        for c in masked[k]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened:
                return k
        if opened and depth <= 0:
            return k
    return len(masked) - 1 if opened else first


def extract(text: str, lang: str) -> dict:
    """symbols, calls, imports and chunks of a text."""
    lines = text.split("\n")
    found, calls, imports, scopes = None, [], [], []
    if lang == "Python":
        try:
            found, calls, imports = _python(ast.parse(text), lines)
        except (SyntaxError, ValueError, RecursionError):
            imports = [m for m in re.findall(r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))", text, re.M) for m in m if m]
    if found is None:
        style = "hash" if lang in ("Python", "Ruby") else "rust" if lang == "Rust" else "slash"
        masked_text = _MASK[style].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        masked = masked_text.split("\n")
        found = []
        for k, line in enumerate(masked):
            for pattern, kind in _COMPILED.get(lang, []):
                m = pattern.match(line)
                if m:
                    name = m.group(m.lastindex)
                    found.append({"name": name, "kind": kind, "start_line": k + 1, "end_line": _end(masked, k, lang) + 1, "signature": lines[k].strip()[:SIGNATURE], "owner": m.groupdict().get("owner")})
                    break
            if lang == "Swift" and (m := re.match(r"^\s*(?:\w+\s+)*extension\s+(?:\w+\.)*([A-Za-z_]\w*)", line)):
                scopes.append((k + 1, _end(masked, k, lang) + 1, m.group(1)))
            if lang == "Rust" and (m := re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)", line)):
                scopes.append((k + 1, _end(masked, k, lang) + 1, m.group(1)))
        heads = {(d["start_line"], d["name"]) for d in found}
        starts = [0]
        for line in masked:
            starts.append(starts[-1] + len(line) + 1)
        for m in _CALL.finditer(masked_text):
            line = bisect.bisect_right(starts, m.start(3))
            if m.group(3) not in _NO_CALL and (line, m.group(3)) not in heads:
                calls.append((m.group(3), line, False, qualifier(m.group(1) or "") if m.group(2) else None, bool(m.group(2))))
        if lang in _HERITAGE:
            for m in _HERITAGE[lang].finditer(masked_text):
                for base in re.split(r"\s*[,&]\s*|\s+(?:extends|implements)\s+", re.sub(r"<[^>]*>", "", m.group(1)).strip()):
                    name = re.split(r"\.|::|\\", base.strip())[-1]
                    if name.isidentifier() and name not in ("implements", "extends"):
                        calls.append((name, bisect.bisect_right(starts, m.start()), True, None, False))
        if lang in _IMPORTS:
            imports = [g for m in _IMPORTS[lang].finditer(text) for g in m.groups() if g]
    symbols = nest(found, scopes)
    facts = [{"name": n, "line": line, "from_symbol": _caller(symbols, line), "heritage": h, "qual": q, "is_member": member} for n, line, h, q, member in sorted(calls, key=lambda c: (c[1], c[0]))]
    return {"symbols": symbols, "calls": facts, "imports": sorted({c for c in map(clean_import, imports) if c}), "chunks": chunk(symbols, lines)}


def _all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [{"repo_id": r, "file_id": f, **extract(t, lang)} for r, f, lang, t in zip(batch["repo_id"], batch["file_id"], batch["lang"], batch["content"], strict=True)]
        for row in rows:
            row["symbols"] = [{k: s.get(k) for k in ("at", "name", "kind", "start_line", "end_line", "owner", "parent", "signature")} for s in row["symbols"]]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("repo_id", "file_id", "symbols", "calls", "imports", "chunks")])


def file_facts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """One row (FACTS) per file with a language and a text.  files: repo_id, file_id, lang.  texts: file_id, content."""
    ready = texts.join(files.where(F.col("lang").isNotNull()).select("repo_id", "file_id", "lang"), "file_id").select("repo_id", F.col("file_id").cast("long").alias("file_id"), "lang", "content")
    return ready.mapInPandas(_all, FACTS)
