"""Schema catalogue: tables, columns, keys and indexes from DDL and ORM sources, and the code that uses them."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IDENT = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w$]+)(?:\s*\.\s*(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w$]+))*'


def unquote(s: str) -> str:
    return s.strip().strip("\"`[]'")


def split_name(raw: str) -> tuple[str | None, str]:
    """(schema, table); the default schemas count as none."""
    parts = [p for p in map(unquote, raw.split(".")) if p]
    if not parts:
        return None, ""
    schema = parts[-2] if len(parts) > 1 else None
    return (None if schema and schema.lower() in ("public", "main", "dbo") else schema), parts[-1]


def statements(sql: str) -> list[str]:
    """SQL without comments, cut at semicolons outside quotes, dollar quotes and parentheses."""
    out, at, depth, buffer = [], 0, 0, []
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\$(\w*)\$.*?\$\1\$|[();]|[^-/'\"`$();]+|.", re.S)
    for m in token.finditer(sql, at):
        t = m.group()
        if t.startswith(("--", "/*")):
            buffer.append(" ")
        elif t == ";" and depth == 0:
            out.append("".join(buffer).strip())
            buffer = []
        else:
            depth += (t == "(") - (t == ")")
            buffer.append(t)
    out.append("".join(buffer).strip())
    return [s for s in out if s]


def parts(text: str) -> list[str]:
    """A list cut at commas outside quotes and parentheses."""
    out, depth, buffer = [], 0, []
    for t in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|[(),]|[^'\"(),]+|.", text, re.S):
        if t == "," and depth == 0:
            out.append("".join(buffer).strip())
            buffer = []
        else:
            depth += (t == "(") - (t == ")")
            buffer.append(t)
    out.append("".join(buffer).strip())
    return [p for p in out if p]


def _names(text: str) -> list[str]:
    return [unquote(re.sub(r"\s+(asc|desc)\b.*$", "", p, flags=re.I)) for p in parts(text)]


_CONSTRAINT = re.compile(r"^(?:constraint\s+\S+\s+)?(primary\s+key|unique(?:\s+(?:key|index))?|foreign\s+key|check|exclude|key|index|fulltext|spatial)\b", re.I)
_STOP = re.compile(r"\b(not\s+null|null|primary\s+key|unique|default|references|check|constraint|collate|generated|auto_increment|autoincrement|on\s+update|comment|identity)\b", re.I)
_REF = re.compile(rf"references\s+({_IDENT})\s*(?:\(([^)]*)\))?(?:.*?on\s+delete\s+(cascade|set\s+null|set\s+default|restrict|no\s+action))?", re.I | re.S)


def column(text: str) -> tuple[dict, dict | None] | None:
    """A column definition and the foreign key that it carries."""
    m = re.match(rf"\s*({_IDENT})\s*(.*)$", text, re.S)
    if not m:
        return None
    name, rest = unquote(m.group(1)), m.group(2)
    stop = _STOP.search(rest)
    kind = " ".join((rest[: stop.start()] if stop else rest).split())
    primary = bool(re.search(r"\bprimary\s+key\b", rest, re.I))
    default = re.search(r"\bdefault\s+('(?:[^']|'')*'|\w+(?:\([^)]*\))?|\([^)]*\)|[-\d.]+)", rest, re.I)
    col = {"name": name, "type": kind, "nullable": not primary and not re.search(r"\bnot\s+null\b", rest, re.I), "primary": primary, "unique": bool(re.search(r"\bunique\b", rest, re.I)), "default": default.group(1) if default else None}
    ref = _REF.search(rest)
    return col, ({"columns": [name], "ref": ref.group(1), "ref_columns": _names(ref.group(2) or ""), "on_delete": ref.group(3)} if ref else None)


class Schema:
    """Tables by key, in the order in which statements are applied."""

    def __init__(self) -> None:
        self.tables: dict[str, dict] = {}

    def find(self, raw: str) -> dict | None:
        schema, name = split_name(raw)
        for t in self.tables.values():
            if t["name"].lower() == name.lower() and (schema is None or (t["schema"] or "").lower() == schema.lower()):
                return t
        return None

    def create(self, raw: str, kind: str, source: str, columns: list, keys: list, indexes: list, aliases: list | None = None, replace: bool = True) -> None:
        schema, name = split_name(raw)
        key = f"{schema}.{name}".lower() if schema else name.lower()
        if not replace and key in self.tables:
            old = self.tables[key]
            if ".sql:" in old["source"] and ".sql:" not in source:
                old["source"] = source
            known = {c["name"] for c in old["columns"]}
            old["columns"] += [c for c in columns if c["name"] not in known]
            old["keys"] += keys
            old["indexes"] += indexes
            old["aliases"] += [a for a in aliases or [] if a not in old["aliases"]]
            return
        self.tables[key] = {"schema": schema, "name": name, "kind": kind, "source": source, "columns": columns, "keys": keys, "indexes": indexes, "aliases": list(aliases or [])}

    def constraint(self, table: dict, text: str) -> bool:
        m = _CONSTRAINT.match(text)
        if not m:
            return False
        word = m.group(1).lower().split()[0]
        inner = re.search(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", text)
        names = _names(inner.group(1)) if inner else []
        if word == "primary":
            for c in table["columns"]:
                if c["name"] in names:
                    c["primary"], c["nullable"] = True, False
        elif word == "foreign":
            ref = _REF.search(text)
            if ref:
                table["keys"].append({"columns": names, "ref": ref.group(1), "ref_columns": _names(ref.group(2) or ""), "on_delete": ref.group(3)})
        elif word in ("unique", "key", "index"):
            table["indexes"].append({"name": "", "columns": names, "unique": word == "unique"})
        return True

    def apply(self, statement: str, source: str) -> None:
        """One DDL statement; others change nothing."""
        m = re.match(rf"create\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?({_IDENT})\s*\((.*)\)[^)]*$", statement, re.I | re.S)
        if m:
            table = {"columns": [], "keys": [], "indexes": []}
            later = []
            for p in parts(m.group(2)):
                if _CONSTRAINT.match(p):
                    later.append(p)
                    continue
                got = column(p)
                if got:
                    table["columns"].append(got[0])
                    if got[1]:
                        table["keys"].append(got[1])
            for p in later:
                self.constraint(table, p)
            self.create(m.group(1), "table", source, table["columns"], table["keys"], table["indexes"])
            return
        m = re.match(rf"create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?({_IDENT})", statement, re.I)
        if m:
            self.create(m.group(1), "view", source, [], [], [])
            return
        m = re.match(rf"create\s+(unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({_IDENT})?\s*on\s+(?:only\s+)?({_IDENT})\s*(?:using\s+\w+\s*)?\((.*?)\)\s*(?:where.*)?$", statement, re.I | re.S)
        if m:
            t = self.find(m.group(3))
            if t:
                t["indexes"].append({"name": unquote(m.group(2) or ""), "columns": _names(m.group(4)), "unique": bool(m.group(1))})
            return
        m = re.match(r"drop\s+(?:table|view|materialized\s+view)\s+(?:if\s+exists\s+)?(.*?)(?:\s+cascade|\s+restrict)?$", statement, re.I | re.S)
        if m:
            for raw in parts(m.group(1)):
                t = self.find(raw)
                if t:
                    self.tables = {k: v for k, v in self.tables.items() if v is not t}
            return
        m = re.match(rf"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_IDENT})\s+(.*)$", statement, re.I | re.S)
        if m and (t := self.find(m.group(1))):
            for action in parts(m.group(2)):
                self._alter(t, action, source)

    def _alter(self, t: dict, action: str, source: str) -> None:
        by_name = {c["name"].lower(): c for c in t["columns"]}
        if m := re.match(rf"rename\s+(?:column\s+)?({_IDENT})\s+to\s+({_IDENT})", action, re.I):
            if m.group(1).lower() != "to" and (c := by_name.get(unquote(m.group(1)).lower())):
                c["name"] = unquote(m.group(2))
        elif m := re.match(rf"rename\s+to\s+({_IDENT})", action, re.I):
            self.tables = {k: v for k, v in self.tables.items() if v is not t}
            t["name"] = split_name(m.group(1))[1]
            self.tables[t["name"].lower()] = t
        elif m := re.match(rf"drop\s+(?:column\s+)?(?:if\s+exists\s+)?({_IDENT})", action, re.I):
            if not re.match(r"drop\s+(constraint|primary|foreign|index|key)\b", action, re.I):
                t["columns"] = [c for c in t["columns"] if c["name"].lower() != unquote(m.group(1)).lower()]
        elif m := re.match(r"add\s+(?!column\b)(.*)$", action, re.I | re.S):
            if not self.constraint(t, m.group(1)):
                self._add(t, m.group(1))
        elif m := re.match(r"add\s+column\s+(?:if\s+not\s+exists\s+)?(.*)$", action, re.I | re.S):
            self._add(t, m.group(1))
        elif m := re.match(rf"(?:alter|modify|change)\s+(?:column\s+)?({_IDENT})\s+(.*)$", action, re.I | re.S):
            c = by_name.get(unquote(m.group(1)).lower())
            if c:
                rest = m.group(2)
                if re.match(r"set\s+not\s+null", rest, re.I):
                    c["nullable"] = False
                elif re.match(r"drop\s+not\s+null", rest, re.I):
                    c["nullable"] = True
                elif k := re.match(r"(?:set\s+data\s+)?type\s+(.*?)(?:\s+using\b.*)?$", rest, re.I | re.S):
                    c["type"] = " ".join(k.group(1).split())
                elif k := re.match(r"set\s+default\s+(.*)$", rest, re.I | re.S):
                    c["default"] = k.group(1).strip()
                elif re.match(r"drop\s+default", rest, re.I):
                    c["default"] = None
                elif not re.match(r"(set|drop)\b", rest, re.I) and (got := column(f"{m.group(1)} {rest}")):
                    c.update(got[0])

    def _add(self, t: dict, text: str) -> None:
        got = column(text)
        if got and got[0]["name"].lower() not in {c["name"].lower() for c in t["columns"]}:
            t["columns"].append(got[0])
            if got[1]:
                t["keys"].append(got[1])


def _col(name: str, kind: str, nullable: bool = False, primary: bool = False, unique: bool = False) -> dict:
    return {"name": name, "type": kind, "nullable": nullable and not primary, "primary": primary, "unique": unique, "default": None}


def snake(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)(?=[A-Z][a-z])", lambda m: f"{m.group(1)}_{m.group(2)}" if m.group(1) else f"{m.group(3)}_", name).lower()


def read_prisma(s: Schema, source: str, text: str) -> None:
    models = dict(re.findall(r"^model\s+(\w+)\s*\{(.*?)^\}", text, re.M | re.S))
    tables = {m: (k.group(1) if (k := re.search(r'@@map\("([^"]+)"\)', body)) else m) for m, body in models.items()}
    for model, body in models.items():
        columns, keys, indexes = [], [], []
        renamed = {}
        for line in body.splitlines():
            f = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?\s*(.*)$", line.split("//")[0])
            if not f or line.strip().startswith("@@"):
                continue
            name, kind, many, optional, rest = f.groups()
            if kind in models:
                r = re.search(r"@relation\(.*?fields:\s*\[([^\]]+)\].*?references:\s*\[([^\]]+)\](?:.*?onDelete:\s*(\w+))?", rest)
                if r and not many:
                    keys.append({"columns": [x.strip() for x in r.group(1).split(",")], "ref": tables[kind], "ref_columns": [x.strip() for x in r.group(2).split(",")], "on_delete": r.group(3)})
                continue
            mapped = re.search(r'@map\("([^"]+)"\)', rest)
            renamed[name] = mapped.group(1) if mapped else name
            columns.append(_col(renamed[name], kind + (many or ""), bool(optional), "@id" in rest, "@unique" in rest))
        for m in re.finditer(r"@@(index|unique|id)\(\[([^\]]+)\]", body):
            names = [renamed.get(x.strip(), x.strip()) for x in m.group(2).split(",")]
            if m.group(1) == "id":
                for c in columns:
                    c["primary"] |= c["name"] in names
            else:
                indexes.append({"name": "", "columns": names, "unique": m.group(1) == "unique"})
        for k in keys:
            k["columns"] = [renamed.get(c, c) for c in k["columns"]]
        s.create(tables[model], "table", f"{source}:{model}", columns, keys, indexes, [model], replace=False)


def read_drizzle(s: Schema, source: str, text: str) -> None:
    names = {v: t for v, t in re.findall(r"(?:const|let)\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\(\s*[\"'](\w+)[\"']", text)}
    for m in re.finditer(r"(?:const|let)\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\(\s*[\"'](\w+)[\"']\s*,\s*\{(.*?)\n\s*\}", text, re.S):
        columns, keys = [], []
        for c in re.finditer(r"(\w+)\s*:\s*(\w+)\(\s*(?:[\"'](\w+)[\"'])?(.*?)(?=,\s*\n|,?\s*$|,\s+\w+\s*:)", m.group(3), re.S):
            name, rest = c.group(3) or c.group(1), c.group(4)
            columns.append(_col(name, c.group(2), ".notNull()" not in rest, ".primaryKey(" in rest, ".unique(" in rest))
            if r := re.search(r"\.references\(\s*\(\)\s*=>\s*(\w+)\.(\w+)", rest):
                keys.append({"columns": [name], "ref": names.get(r.group(1), r.group(1)), "ref_columns": [r.group(2)], "on_delete": None})
        s.create(m.group(2), "table", f"{source}:{m.group(1)}", columns, keys, [], [m.group(1)], replace=False)


def read_diesel(s: Schema, source: str, text: str) -> None:
    for m in re.finditer(r"(?:diesel::)?table!\s*\{\s*(?:use[^;]*;\s*)*([\w.]+)\s*\(([^)]*)\)\s*\{(.*?)\}\s*\}", text, re.S):
        primary = {x.strip() for x in m.group(2).split(",")}
        columns = [_col(n, k, k.startswith("Nullable"), n in primary) for n, k in re.findall(r"(\w+)\s*->\s*([\w<>]+)", m.group(3))]
        s.create(m.group(1), "table", f"{source}:{m.group(1)}", columns, [], [], [split_name(m.group(1))[1]], replace=False)
    for child, parent, col in re.findall(r"joinable!\(\s*(\w+)\s*->\s*(\w+)\s*\((\w+)\)\s*\)", text):
        if t := s.find(child):
            t["keys"].append({"columns": [col], "ref": parent, "ref_columns": [], "on_delete": None})


def _text(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


def _keywords(call: ast.Call) -> dict[str, ast.expr]:
    return {k.arg: k.value for k in call.keywords if k.arg}


def _constant(node: ast.expr | None, otherwise=None):
    return node.value if isinstance(node, ast.Constant) else otherwise


def read_sqlalchemy(s: Schema, source: str, tree: ast.Module) -> None:
    for cls in [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]:
        table, columns, keys = None, [], []
        for item in cls.body:
            target = item.targets[0] if isinstance(item, ast.Assign) else item.target if isinstance(item, ast.AnnAssign) else None
            if not isinstance(target, ast.Name) or item.value is None:
                continue
            if target.id == "__tablename__":
                table = _constant(item.value)
            elif isinstance(item.value, ast.Call) and _text(item.value.func).split(".")[-1] in ("Column", "mapped_column"):
                call, kw = item.value, _keywords(item.value)
                named = [a for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
                name = named[0].value if named else target.id
                kinds = [a for a in call.args if not isinstance(a, ast.Constant) and "ForeignKey" not in _text(a)]
                kind = _text(kinds[0]) if kinds else re.sub(r"^Mapped\[(.*)\]$", r"\1", _text(item.annotation)) if isinstance(item, ast.AnnAssign) else ""
                primary = bool(_constant(kw.get("primary_key"), False))
                nullable = _constant(kw.get("nullable"), "None" in kind or "Optional" in kind or not isinstance(item, ast.AnnAssign))
                columns.append(_col(name, kind, bool(nullable), primary, bool(_constant(kw.get("unique"), False))))
                for a in call.args:
                    if isinstance(a, ast.Call) and _text(a.func).endswith("ForeignKey") and a.args:
                        ref = str(_constant(a.args[0], "")).rsplit(".", 1)
                        keys.append({"columns": [name], "ref": ref[0], "ref_columns": ref[1:], "on_delete": _constant(_keywords(a).get("ondelete"))})
        if table:
            s.create(table, "table", f"{source}:{cls.name}", columns, keys, [], [cls.name], replace=False)


_DJANGO_LINKS = ("ForeignKey", "OneToOneField", "ManyToManyField", "ParentalKey")


def read_django(s: Schema, modules: list[tuple[str, ast.Module]]) -> None:
    """All model classes of a project: abstract bases are copied in, proxies share a table, children link to their parent."""
    classes: dict[str, tuple[str, ast.ClassDef, str]] = {}
    for path, tree in modules:
        app = path.rsplit("/", 2)[-2] if "/" in path else ""
        if app in ("models", "migrations") and path.count("/") > 1:
            app = path.rsplit("/", 3)[-3]
        for n in ast.walk(tree):
            if isinstance(n, ast.ClassDef):
                classes[n.name] = (path, n, app)

    def meta(cls: ast.ClassDef) -> dict[str, ast.expr]:
        for item in cls.body:
            if isinstance(item, ast.ClassDef) and item.name == "Meta":
                out: dict[str, ast.expr] = {}
                for base in item.bases:  # Meta(Base.Meta)
                    owner = _text(base).split(".")[0]
                    if owner in classes and owner != cls.name:
                        out |= {k: v for k, v in meta(classes[owner][1]).items() if k != "abstract"}
                return out | {t.id: a.value for a in item.body if isinstance(a, ast.Assign) for t in a.targets if isinstance(t, ast.Name)}
        return {}

    def is_model(name: str, seen: frozenset = frozenset()) -> bool:
        if name not in classes or name in seen:
            return False
        bases = [_text(b).split(".")[-1] for b in classes[name][1].bases]
        return any(b in ("Model", "AbstractUser", "AbstractBaseUser", "MPTTModel", "PolymorphicModel") or is_model(b, seen | {name}) for b in bases)

    def abstract(name: str) -> bool:
        return bool(_constant(meta(classes[name][1]).get("abstract"), False))

    def table_of(name: str) -> str:
        m = meta(classes[name][1])
        if _constant(m.get("proxy"), False):
            for b in classes[name][1].bases:
                base = _text(b).split(".")[-1]
                if base in classes and not abstract(base):
                    return table_of(base)
        return _constant(m.get("db_table")) or f"{classes[name][2]}_{name.lower()}".lstrip("_")

    def fields(name: str, seen: frozenset = frozenset()) -> list[tuple[str, ast.Call]]:
        out: dict[str, ast.Call] = {}
        for b in classes[name][1].bases:
            base = _text(b).split(".")[-1]
            if base in classes and base not in seen and abstract(base):
                out |= dict(fields(base, seen | {name}))
        for item in classes[name][1].body:
            if isinstance(item, ast.Assign) and isinstance(item.targets[0], ast.Name) and isinstance(item.value, ast.Call):
                kind = _text(item.value.func).split(".")[-1]
                if kind.endswith("Field") or kind in _DJANGO_LINKS:
                    out[item.targets[0].id] = item.value
        return list(out.items())

    for name, (path, cls, _) in sorted(classes.items()):
        if not is_model(name) or abstract(name) or _constant(meta(cls).get("proxy"), False):
            continue
        columns, keys, joins = [], [], []
        for field, call in fields(name):
            kind, kw = _text(call.func).split(".")[-1], _keywords(call)
            target = _text(call.args[0] if call.args else kw.get("to")).strip("'\"").split(".")[-1] if kind in _DJANGO_LINKS else ""
            target = {"self": name, "AUTH_USER_MODEL": "User"}.get(target, target)
            ref = table_of(target) if target in classes else target.lower()
            if kind == "ManyToManyField":
                if "through" not in kw:
                    joins.append((field, ref))
                continue
            db = _constant(kw.get("db_column")) or (f"{field}_id" if kind in _DJANGO_LINKS else field)
            primary = bool(_constant(kw.get("primary_key"), False))
            columns.append(_col(db, kind, bool(_constant(kw.get("null"), False)), primary, bool(_constant(kw.get("unique"), False)) or kind == "OneToOneField"))
            if kind in _DJANGO_LINKS:
                keys.append({"columns": [db], "ref": ref, "ref_columns": ["id"], "on_delete": _text(kw.get("on_delete")).split(".")[-1] or None})
        parents = [_text(b).split(".")[-1] for b in cls.bases]
        for parent in parents:
            if parent in classes and is_model(parent) and not abstract(parent):
                columns.insert(0, _col(f"{parent.lower()}_ptr_id", "OneToOneField", primary=True))
                keys.append({"columns": [f"{parent.lower()}_ptr_id"], "ref": table_of(parent), "ref_columns": ["id"], "on_delete": "CASCADE"})
        if not any(c["primary"] for c in columns):
            columns.insert(0, _col("id", "AutoField", primary=True))
        table = table_of(name)
        s.create(table, "table", f"{path}:{name}", columns, keys, [], [name], replace=False)
        for field, ref in joins:
            pair = [f"{name.lower()}_id", f"{ref.rsplit('_', 1)[-1]}_id"]
            links = [{"columns": [pair[0]], "ref": table, "ref_columns": ["id"], "on_delete": None}, {"columns": [pair[1]], "ref": ref, "ref_columns": ["id"], "on_delete": None}]
            s.create(f"{table}_{field}", "table", f"{path}:{name}.{field}", [_col("id", "AutoField", primary=True), _col(pair[0], "bigint"), _col(pair[1], "bigint")], links, [], [], replace=False)


_SKIPPED = re.compile(r"(?i)(^|/)(fixtures?|seeds?|testdata)(/|$)|\bdown\.sql$|rollback|revert|alembic/versions/")


def read_sources(files: list[tuple[str, str]]) -> Schema:
    """The schema of one repository from (path, text), SQL in path order first; rollbacks, seeds and fixtures are skipped."""
    s = Schema()
    wanted = sorted((p, t) for p, t in files if not _SKIPPED.search(p))
    for path, text in wanted:
        if path.lower().endswith(".sql"):
            for n, statement in enumerate(statements(text), 1):
                s.apply(statement, f"{path}:{n}")
    django = []
    for path, text in wanted:
        if path.endswith(".prisma"):
            read_prisma(s, path, text)
        elif path.endswith((".ts", ".js")) and re.search(r"\b(?:pg|mysql|sqlite)Table\(", text):
            read_drizzle(s, path, text)
        elif path.endswith(".rs") and "table!" in text:
            read_diesel(s, path, text)
        elif path.endswith(".py") and re.search(r"models\.|__tablename__", text):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError):
                continue
            if "__tablename__" in text:
                read_sqlalchemy(s, path, tree)
            if "models." in text and "/migrations/" not in path:
                django.append((path, tree))
    read_django(s, django)
    return s


TABLES = (
    "repo_id string, schema string, name string, kind string, source string, columns array<struct<name:string,type:string,nullable:boolean,primary:boolean,unique:boolean,default:string>>, "
    "keys array<struct<columns:array<string>,ref:string,ref_columns:array<string>,on_delete:string>>, indexes array<struct<name:string,columns:array<string>,unique:boolean>>, aliases array<string>")


def _replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    s = read_sources(list(zip(rows["path"], rows["content"], strict=True)))
    return pd.DataFrame([{"repo_id": key[0], "payload": json.dumps(t)} for t in s.tables.values()], columns=["repo_id", "payload"])


def schema_tables(sources: DataFrame) -> DataFrame:
    """The tables (TABLES) of each repository from its sources (repo_id, path, content).

    Only files that can define tables reach the replay; statements count in path order, so a repository's
    definitions, not its files, meet in one task.  Null contents are left out.
    """
    likely = F.col("path").rlike(r"(?i)\.(sql|prisma)$") | F.col("content").rlike(r"\b(?:pg|mysql|sqlite)Table\(|table!\s*\{|__tablename__|models\.\w*(?:Model|Field|ForeignKey)\b")
    defining = sources.where(F.col("content").isNotNull() & F.col("path").isNotNull() & likely).select("repo_id", "path", "content")
    replayed = defining.groupBy("repo_id").applyInPandas(_replay, "repo_id string, payload string")
    shape = TABLES.split(", ", 1)[1]
    return replayed.select("repo_id", F.from_json("payload", shape).alias("t")).select("repo_id", "t.*")


def foreign_keys(tables: DataFrame) -> DataFrame:
    """(repo_id, table, columns, ref_table): each foreign key with the table it means, by name, else by alias, else null."""
    full = F.when(F.col("schema").isNotNull(), F.concat_ws(".", "schema", "name")).otherwise(F.col("name"))
    keyed = tables.withColumn("table", full)
    bare = F.lower(F.regexp_replace(F.regexp_replace("k.ref", r'["`\[\]]', ""), r"(?i)^(public|main|dbo)\.", ""))
    keys = keyed.select("repo_id", "table", F.explode("keys").alias("k")).select("repo_id", "table", F.array_join("k.columns", ",").alias("columns"), bare.alias("ref"))
    names = keyed.select("repo_id", F.col("table").alias("ref_table"), F.explode(F.array_distinct(F.array(F.lower("table"), F.lower("name")))).alias("ref")).withColumn("tier", F.lit(0))
    aliases = keyed.select("repo_id", F.col("table").alias("ref_table"), F.explode(F.transform("aliases", F.lower)).alias("ref")).withColumn("tier", F.lit(1))
    best = names.unionByName(aliases).groupBy("repo_id", "ref").agg(F.min_by("ref_table", F.struct("tier", "ref_table")).alias("ref_table"))
    return keys.join(best, ["repo_id", "ref"], "left").select("repo_id", "table", "columns", "ref_table")


def referenced_by(keys: DataFrame) -> DataFrame:
    """(repo_id, ref_table, tables): which tables point to each."""
    return keys.where(F.col("ref_table").isNotNull()).groupBy("repo_id", "ref_table").agg(F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables"))


def code_references(names: DataFrame, texts: DataFrame, most: int = 60) -> DataFrame:
    """(repo_id, name, file_id, line): lines of code, imports left out, on which a name of the repository stands as a word; at most
    `most` a name, first by file and line.  names: repo_id, name.  texts: repo_id, file_id, content."""
    from pyspark.sql import Window

    lines = texts.select("repo_id", "file_id", F.posexplode(F.split("content", "\n")).alias("i", "text")).where(~F.col("text").rlike(r"^\s*(import|from|use|#include|require|package)\b"))
    words = lines.select("repo_id", "file_id", (F.col("i") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    hits = words.join(names.distinct(), ["repo_id", "name"]).distinct()
    order = Window.partitionBy("repo_id", "name").orderBy("file_id", "line")
    return hits.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("repo_id", "name", "file_id", "line")


def sqlite_catalog(path: str) -> Iterator[dict]:
    """The tables of a SQLite file, opened for reading only, in the shape of TABLES."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        db.execute("PRAGMA query_only = ON")
        for (name, kind) in db.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            columns = [{"name": c, "type": t, "nullable": not n and not p, "primary": bool(p), "unique": False, "default": d} for _, c, t, n, d, p in db.execute("SELECT * FROM pragma_table_info(?)", (name,))]
            links: dict[int, dict] = {}
            for k, _, ref, col, to, _, on_delete, _ in db.execute("SELECT * FROM pragma_foreign_key_list(?)", (name,)):
                key = links.setdefault(k, {"columns": [], "ref": ref, "ref_columns": [], "on_delete": on_delete})
                key["columns"].append(col)
                key["ref_columns"].append(to)
            indexes = [{"name": i, "unique": bool(u), "columns": [r[2] for r in db.execute("SELECT * FROM pragma_index_info(?)", (i,))]} for _, i, u, *_ in db.execute("SELECT * FROM pragma_index_list(?)", (name,)).fetchall()]
            yield {"repo_id": "", "schema": None, "name": name, "kind": kind, "source": path, "columns": columns, "keys": list(links.values()), "indexes": indexes, "aliases": []}


def live_catalog(spark, url: str, properties: dict[str, str], driver: str) -> dict[str, DataFrame]:
    """Columns, keys and indexes of a live database over JDBC, in a read-only session; needs the driver's jar."""
    queries = {
        "postgresql": {
            "columns": "SELECT table_schema, table_name, column_name, data_type, is_nullable, column_default, ordinal_position FROM information_schema.columns WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
            "keys": "SELECT c.conrelid::regclass::text AS table_name, c.confrelid::regclass::text AS ref_table, pg_get_constraintdef(c.oid) AS definition FROM pg_constraint c WHERE contype = 'f'",
            "indexes": "SELECT schemaname, tablename, indexname, indexdef FROM pg_indexes WHERE schemaname NOT IN ('pg_catalog', 'information_schema')"},
        "mysql": {
            "columns": "SELECT table_schema, table_name, column_name, column_type, is_nullable, column_default, ordinal_position FROM information_schema.columns WHERE table_schema = DATABASE()",
            "keys": "SELECT table_name, column_name, referenced_table_name, referenced_column_name, constraint_name, ordinal_position FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL AND table_schema = DATABASE()",
            "indexes": "SELECT table_name, index_name, column_name, non_unique, seq_in_index FROM information_schema.statistics WHERE table_schema = DATABASE()"}}
    reader = spark.read.format("jdbc").options(url=url, sessionInitStatement="SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY" if driver == "postgresql" else "SET SESSION TRANSACTION READ ONLY", **properties)
    return {name: reader.option("query", q).load() for name, q in queries[driver].items()}


def redact(message: str, url: str) -> str:
    """A message without the address and the password of a connection."""
    secret = re.search(r"//[^:/@]+:([^@]+)@", url)
    out = message.replace(url, "<url>")
    return out.replace(secret.group(1), "***") if secret else out
