"""Packrat parsing of expression grammars over strings of token kinds.

A grammar is text: `Rule <- expression` on one or more lines.  Expressions: "literal" (a token), NAME (a rule or
a class of tokens), sequence, `/` (ordered choice), `*`, `+`, `?`, `&e`, `!e`, `.` and parentheses.  Every rule
that can recur is a memoised function of the position; whatever cannot recur is fused into one possessive
pattern, which is the same expression matched in one step.  To report the furthest failure, a grammar is also
compiled without fusing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# Steps that a rule may take whose results are not kept, and how deep rules are written into others.
_LIGHT, _DEEPEST = 60, 16

_TOKEN = re.compile(r'\s*(?:(?P<lit>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*@?\w*)|(?P<op><-|[/()*+?&!.]))')


@dataclass(frozen=True)
class Char:
    chars: str


@dataclass(frozen=True)
class Any_:
    pass


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Seq:
    items: tuple


@dataclass(frozen=True)
class Alt:
    items: tuple


@dataclass(frozen=True)
class Rep:
    item: object
    least: int
    most: int | None


@dataclass(frozen=True)
class Look:
    item: object
    wanted: bool


class _Reader:
    def __init__(self, text: str, kinds: dict[str, str], classes: dict[str, str]):
        self.kinds, self.classes = kinds, classes
        self.tokens: list[tuple[str, str]] = []
        for line in text.strip().splitlines():
            line = line.split("  --")[0]
            at = 0
            while at < len(line.rstrip()):
                m = _TOKEN.match(line, at)
                if not m:
                    raise ValueError(f"grammar: {line[at:]}")
                self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
                at = m.end()
        self.at = 0

    def rules(self) -> dict[str, object]:
        out = {}
        while self.at < len(self.tokens):
            name = self.tokens[self.at][1]
            if self.tokens[self.at + 1][1] != "<-":
                raise ValueError(f"grammar: expected <- after {name}")
            self.at += 2
            out[name] = self.choice()
        return out

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def choice(self):
        items = [self.sequence()]
        while self.peek() == "/":
            self.at += 1
            items.append(self.sequence())
        return items[0] if len(items) == 1 else Alt(tuple(items))

    def sequence(self):
        items = []
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if value in ("/", ")") and kind == "op":
                break
            if kind == "name" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "<-":
                break
            items.append(self.prefix())
        return items[0] if len(items) == 1 else Seq(tuple(items))

    def prefix(self):
        kind, value = self.tokens[self.at]
        if kind == "op" and value in "&!":
            self.at += 1
            return Look(self.prefix(), value == "&")
        e = self.primary()
        while self.peek() in ("*", "+", "?") and self.tokens[self.at][0] == "op":
            sign = self.peek()
            self.at += 1
            e = Rep(e, 1 if sign == "+" else 0, 1 if sign == "?" else None)
        return e

    def primary(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "lit":
            return Char(self.kinds[value[1:-1]])
        if kind == "name":
            return Char(self.classes[value]) if value in self.classes else Ref(value)
        if value == "(":
            e = self.choice()
            if self.peek() != ")":
                raise ValueError("grammar: ) expected")
            self.at += 1
            return e
        if value == ".":
            return Any_()
        raise ValueError(f"grammar: {value}")


class Grammar:
    """A compiled grammar; `match(kinds)` tells whether the first rule takes in the whole string."""

    def __init__(self, text: str, kinds: dict[str, str], classes: dict[str, str]):
        self.rules = _Reader(text, kinds, classes).rules()
        self.start = next(iter(self.rules))
        missing = {r for e in self.rules.values() for r in self._refs(e)} - set(self.rules)
        if missing:
            raise ValueError(f"no rules: {sorted(missing)}")
        self.asks = {name: self._refs(e) for name, e in self.rules.items()}
        self.recursive = {name for name in self.rules if self._reaches(name, name)}
        self.fused: dict[object, str] = {}
        self._first_cache: dict[str, tuple[frozenset | None, bool]] = {}
        self._unkept()
        self._run = {True: self._compile(True)}

    def _refs(self, e) -> set[str]:
        if isinstance(e, Ref):
            return {e.name}
        if isinstance(e, (Seq, Alt)):
            return set().union(*[self._refs(x) for x in e.items]) if e.items else set()
        if isinstance(e, (Rep, Look)):
            return self._refs(e.item)
        return set()

    def _reaches(self, start: str, goal: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            for r in self.asks[todo.pop()]:
                if r == goal:
                    return True
                if r not in seen:
                    seen.add(r)
                    todo.append(r)
        return False

    def _flat(self, e) -> bool:
        return all(r not in self.recursive and all(self._flat(Ref(x)) for x in self.asks[r]) for r in self._refs(e))

    def _pattern(self, e) -> str:
        if isinstance(e, Char):
            return re.escape(e.chars) if len(e.chars) == 1 else "[" + "".join(map(re.escape, e.chars)) + "]"
        if isinstance(e, Any_):
            return "[^\\x00]"
        if isinstance(e, Ref):
            return self._pattern(self.rules[e.name])
        if isinstance(e, Seq):
            return "".join(self._pattern(x) for x in e.items)
        if isinstance(e, Alt):
            if all(isinstance(x, Char) for x in e.items):
                return self._pattern(Char("".join(x.chars for x in e.items)))
            return "(?>" + "|".join(self._pattern(x) for x in e.items) + ")"
        if isinstance(e, Rep):
            inner = self._pattern(e.item)
            group = inner if isinstance(e.item, Char) else f"(?:{inner})"
            return group + ("?+" if e.most == 1 else "++" if e.least else "*+")
        return f"(?={self._pattern(e.item)})" if e.wanted else f"(?!{self._pattern(e.item)})"

    def _first(self, e, depth: int = 0) -> tuple[frozenset | None, bool]:
        """(characters that e can begin with, or None for any; whether e can be empty)."""
        if depth > 400:
            return None, True
        if isinstance(e, Char):
            return frozenset(e.chars), False
        if isinstance(e, Any_):
            return None, False
        if isinstance(e, Ref):
            if e.name not in self._first_cache:
                self._first_cache[e.name] = (None, True)
                self._first_cache[e.name] = self._first(self.rules[e.name], depth + 1)
            return self._first_cache[e.name]
        if isinstance(e, Seq):
            chars: frozenset = frozenset()
            for x in e.items:
                f, empty = self._first(x, depth + 1)
                if f is None:
                    return None, empty
                chars |= f
                if not empty:
                    return chars, False
            return chars, True
        if isinstance(e, Alt):
            chars, some = frozenset(), False
            for x in e.items:
                f, empty = self._first(x, depth + 1)
                some |= empty
                if f is None:
                    return None, True
                chars |= f
            return chars, some
        if isinstance(e, Rep):
            f, empty = self._first(e.item, depth + 1)
            return f, empty or e.least == 0
        return (self._first(e.item, depth + 1)[0], True) if e.wanted else (frozenset(), True)

    def _refs_at(self, e, head: bool) -> Iterator[tuple[str, bool]]:
        """(rule, whether it is asked at most once and only where e begins) for each place in e that asks a rule."""
        if isinstance(e, Ref):
            yield e.name, head
        elif isinstance(e, Seq):
            for x in e.items:
                yield from self._refs_at(x, head)
                head = head and isinstance(x, Look)
        elif isinstance(e, Alt):
            for x in e.items:
                yield from self._refs_at(x, head)
        elif isinstance(e, Rep):
            yield from self._refs_at(e.item, head and e.most == 1)
        elif isinstance(e, Look):
            yield from self._refs_at(e.item, head)

    def _loops(self, e) -> bool:
        """Whether e repeats, without bound, what is not one pattern."""
        if isinstance(e, (Seq, Alt)):
            return any(self._loops(x) for x in e.items)
        if isinstance(e, Rep) and e.most is None:
            return not self._flat(e.item)
        if isinstance(e, Ref):
            return e.name in self.once and self._loops(self.rules[e.name])
        return isinstance(e, (Rep, Look)) and self._loops(e.item)

    def _asked(self, name: str) -> list[str]:
        """The rules that a rule asks, those in `once` replaced by what they ask."""
        out: list[str] = []
        for r, _ in self._refs_at(self.rules[name], True):
            if not self._flat(Ref(r)):
                out += self._asked(r) if r in self.once else [r]
        return out

    def _unkept(self) -> None:
        """Finds the rules whose results need not be kept for the parse to stay linear.

        once: asked in one place only, where another rule begins, so never twice at a position.  light: without
        loops, and all that they ask is kept or as light, so asking again is a bounded number of steps.
        """
        places: dict[str, list[tuple[str, bool]]] = {name: [] for name in self.rules}
        for name, e in self.rules.items():
            for r, head in self._refs_at(e, True):
                places[r].append((name, head))
        self.once: set[str] = set()
        for name, at in places.items():
            if name != self.start and len(at) == 1 and at[0][1] and not self._flat(Ref(name)):
                # A circle of such rules would keep nothing.
                above = at[0][0]
                while above in self.once and above != name:
                    above = places[above][0][0]
                if above != name:
                    self.once.add(name)
        self.light: dict[str, int] = {}
        for name in sorted(self.rules, key=lambda r: -len(places[r])):
            if name == self.start or name in self.once or self._flat(Ref(name)) or self._loops(self.rules[name]):
                continue
            asked = self._asked(name)
            seen, todo = set(asked), [r for r in asked if r in self.light]
            while todo:
                for r in self._asked(todo.pop()):
                    if r not in seen:
                        seen.add(r)
                        todo += [r] if r in self.light else []
            steps = 1 + sum(self.light.get(r, 1) for r in asked)
            if name not in seen and steps <= _LIGHT:
                self.light[name] = steps
                # Rules that ask this one have become longer by it.
                for other in [r for r in self.light if name in self._asked(r)]:
                    self.light[other] += steps
        self.single = {name for name, at in places.items() if len(at) == 1}

    def _one_of(self, e) -> str | None:
        """The characters that e takes one of, if that is all that it does."""
        if isinstance(e, Char):
            return e.chars
        if isinstance(e, Alt):
            parts = [self._one_of(x) for x in e.items]
            return None if None in parts else "".join(parts)
        return None

    def _compile(self, fuse: bool):
        lines: list[str] = []
        env: dict[str, object] = {}
        count = [0]
        wanted: dict[str, None] = {self.start: None} if fuse else dict.fromkeys(self.rules)

        def fresh(stem: str) -> str:
            count[0] += 1
            return f"{stem}{count[0]}"

        def pattern(e) -> str:
            if e not in self.fused:
                self.fused[e] = self._pattern(e)
            name = fresh("m")
            env[name] = re.compile(self.fused[e]).match
            return name

        def among(at: str, chars: str) -> str:
            return f"s[{at}] == {chars!r}" if len(chars) == 1 else f"s[{at}] in {chars!r}"

        def guard(e) -> str | None:
            """The characters that e can begin with, if it can't be empty."""
            first, empty = self._first(e)
            return None if not fuse or first is None or empty else "".join(sorted(first))

        def emit(e, at: str, out: str, pad: str) -> None:
            """Code that sets `out` to the position after e at `at`, or to -1."""
            if fuse and self._one_of(e):
                lines.append(f"{pad}{out} = {at} + 1 if {among(at, self._one_of(e))} else -1")
                return
            if fuse and isinstance(e, Look) and self._one_of(e.item):
                test = among(at, self._one_of(e.item))
                lines.append(f"{pad}{out} = {at} if {test} else -1" if e.wanted else f"{pad}{out} = -1 if {test} else {at}")
                return
            if fuse and self._flat(e):
                lines.append(f"{pad}g = {pattern(e)}(s, {at}); {out} = g.end() if g else -1")
                return
            if isinstance(e, Char):
                lines.append(f"{pad}if {among(at, e.chars)}: {out} = {at} + 1")
                lines.append(f"{pad}else:")
                lines.append(f"{pad} {out} = -1")
                lines.append(f"{pad} if {at} > far[0]: far[0] = {at}")
            elif isinstance(e, Any_):
                lines.append(f"{pad}{out} = {at} + 1 if s[{at}] != '\\0' else -1")
            elif isinstance(e, Ref):
                if fuse and (e.name in self.once or e.name in self.light and e.name in self.single) and len(pad) < _DEEPEST:
                    emit(self.rules[e.name], at, out, pad)
                else:
                    wanted[e.name] = None
                    lines.append(f"{pad}{out} = r_{e.name}({at})")
            elif isinstance(e, Seq):
                here = at
                if not e.items:
                    lines.append(f"{pad}{out} = {at}")
                lines.append(f"{pad}while True:")
                for k, x in enumerate(e.items[:-1]):
                    nxt = fresh("p")
                    if fuse and self._one_of(x):
                        lines.append(f"{pad} if not {among(here, self._one_of(x))}:" if len(self._one_of(x)) > 1 else f"{pad} if s[{here}] != {self._one_of(x)!r}:")
                        lines.append(f"{pad}  {out} = -1; break")
                        lines.append(f"{pad} {nxt} = {here} + 1")
                    elif fuse and self._flat(x) and not isinstance(x, Look):
                        lines.append(f"{pad} g = {pattern(x)}(s, {here})")
                        lines.append(f"{pad} if g is None:")
                        lines.append(f"{pad}  {out} = -1; break")
                        lines.append(f"{pad} {nxt} = g.end()")
                    else:
                        emit(x, here, nxt, pad + " ")
                        if not (fuse and isinstance(x, Rep) and not x.least):
                            lines.append(f"{pad} if {nxt} < 0:")
                            lines.append(f"{pad}  {out} = -1; break")
                    here = nxt
                if e.items:
                    emit(e.items[-1], here, out, pad + " ")
                lines.append(f"{pad} break")
            elif isinstance(e, Alt):
                lines.append(f"{pad}while True:")
                lines.append(f"{pad} {out} = -1")
                char = fresh("c")
                if fuse:
                    lines.append(f"{pad} {char} = s[{at}]")
                for x in e.items:
                    inner, chars = pad + " ", guard(x)
                    if chars is not None:
                        lines.append(f"{inner}if {char} {'==' if len(chars) == 1 else 'in'} {chars!r}:")
                        inner += " "
                    emit(x, at, out, inner)
                    lines.append(f"{inner}if {out} >= 0: break")
                lines.append(f"{pad} break")
            elif isinstance(e, Rep):
                here, nxt, chars = fresh("p"), fresh("p"), guard(e.item)
                if e.most == 1:
                    inner = pad
                    if chars is not None:
                        lines.append(f"{pad}{out} = {at}")
                        lines.append(f"{pad}if {among(at, chars)}:")
                        inner += " "
                    emit(e.item, at, nxt, inner)
                    lines.append(f"{inner}{out} = {nxt} if {nxt} >= 0 else {at}")
                    return
                lines.append(f"{pad}{here} = {at}")
                lines.append(f"{pad}while {'True' if chars is None else among(here, chars)}:")
                emit(e.item, here, nxt, pad + " ")
                lines.append(f"{pad} if {nxt} <= {here}: break")
                lines.append(f"{pad} {here} = {nxt}")
                lines.append(f"{pad}{out} = {here}" + (f" if {here} > {at} else -1" if e.least else ""))
            else:
                nxt, kept, inner, chars = fresh("p"), fresh("k"), pad, guard(e.item)
                if not fuse:
                    lines.append(f"{pad}{kept} = far[0]")
                if chars is not None:
                    lines.append(f"{pad}{nxt} = -1")
                    lines.append(f"{pad}if {among(at, chars)}:")
                    inner += " "
                emit(e.item, at, nxt, inner)
                if not fuse:
                    lines.append(f"{pad}far[0] = {kept}")
                lines.append(f"{pad}{out} = {at} if {nxt} {'>=' if e.wanted else '<'} 0 else -1")

        lines.append("def run(s, far):")
        done: list[str] = []
        while len(done) < len(wanted):
            name = next(r for r in wanted if r not in done)
            done.append(name)
            kept = not fuse or name == self.start or not (self._flat(self.rules[name]) or name in self.once or name in self.light)
            if kept:
                lines.append(f" memo_{name} = {{}}")
            lines.append(f" def r_{name}(p):")
            if kept:
                lines.append(f"  q = memo_{name}.get(p)")
                lines.append("  if q is not None: return q")
            emit(self.rules[name], "p", "q", "  ")
            if kept:
                lines.append(f"  memo_{name}[p] = q")
            lines.append("  return q")
        lines.append(f" try: return r_{self.start}(0)")
        # The rules hold each other: without this they and all that they kept stay until the collector comes.
        lines.append(f" finally: {' = '.join(f'r_{name}' for name in done)} = None")
        exec(compile("\n".join(lines), "grammar", "exec"), env)  # noqa: S102
        return env["run"]

    def deep(self, kinds: str) -> tuple[bool, int]:
        """(whether the whole string is taken in, the furthest position refused), with a stack of its own.

        Slower than `matches` and `furthest`, but for strings nested however deep.
        """
        s = kinds + "\0"
        memo: dict[tuple[str, int], int] = {}
        far, looking = 0, 0
        # A frame is an expression, where it began, where it has got to, and which of its parts is next.
        stack: list[list] = [[Ref(self.start), 0, 0, 0]]
        got: int | None = None
        while stack:
            frame = stack[-1]
            e, begin, at, part = frame
            if isinstance(e, Char | Any_):
                taken = s[begin] != "\0" if isinstance(e, Any_) else s[begin] in e.chars
                if not taken and not looking:
                    far = max(far, begin)
                got = begin + 1 if taken else -1
                stack.pop()
                continue
            if part == 0 and isinstance(e, Ref):
                got = memo.get((e.name, begin))
                if got is not None:
                    stack.pop()
                    continue
            if part and got is not None:
                # The part before has ended at `got`.
                if isinstance(e, Seq):
                    at = frame[2] = got
                    if got < 0 or part == len(e.items):
                        stack.pop()
                        continue
                elif isinstance(e, Alt):
                    if got >= 0 or part == len(e.items):
                        stack.pop()
                        continue
                elif isinstance(e, Ref):
                    memo[e.name, begin] = got
                    stack.pop()
                    continue
                elif isinstance(e, Look):
                    looking -= 1
                    got = begin if (got >= 0) == e.wanted else -1
                    stack.pop()
                    continue
                else:
                    if got > at and e.most is None:
                        at = frame[2] = got
                    else:
                        got = max(got, at) if at > begin or e.least == 0 or got > at else -1
                        stack.pop()
                        continue
            if isinstance(e, Seq | Alt) and not e.items:
                got = begin
                stack.pop()
                continue
            frame[3] = part + 1
            if isinstance(e, Seq | Alt):
                stack.append([e.items[part], at if isinstance(e, Seq) else begin, at if isinstance(e, Seq) else begin, 0])
            elif isinstance(e, Ref):
                stack.append([self.rules[e.name], begin, begin, 0])
            else:
                looking += isinstance(e, Look)
                stack.append([e.item, at, at, 0])
            got = None
        return got == len(kinds), min(far, len(kinds))

    def matches(self, kinds: str) -> bool:
        """Whether the whole string is taken in."""
        return self._run[True](kinds + "\0", None) == len(kinds)

    def furthest(self, kinds: str) -> int:
        """The furthest position at which a token was refused."""
        far = [0]
        if False not in self._run:
            self._run[False] = self._compile(False)
        self._run[False](kinds + "\0", far)
        return min(far[0], len(kinds))
