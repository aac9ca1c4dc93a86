"""Which source texts do not parse.

A piece of a text becomes a map from the lexer state at its start to the state
at its end and a bracket summary: one character per token, each balanced group
replaced by one character that tells as what the group is valid (``grammars``),
unmatched brackets kept. Two neighbours compose by following the state and
reducing what their brackets close together, so summaries reduce in any
grouping; what is left of a whole text must be whole items or statements. A
piece is read from the states that are likely; where its start turns out to be
another one it is read again from its text, which a summary carries along.

Python is summarised likewise: statements that are complete within a piece are
parsed there by the interpreter's own parser, the rest is kept as text.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from lodegraph.llm.grammars import BASE, GRAMMARS
from lodegraph.llm.lexing import BAD, CODE, LEXERS, SUB_CLOSE, SUB_OPEN, State
from lodegraph.llm.peg import END

#: fixed values: extensions of the languages that can be parsed here
EXTENSIONS = {"rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go"}
#: Characters of a piece; texts are cut at the line end that follows.
PIECE = 4096
#: Rules call each other as deeply as operators without brackets nest; the frames are on the heap.
DEPTH = 1_000_000

_CLOSES = {")": "(", "]": "[", "}": "{", SUB_CLOSE: SUB_OPEN}
_BRACKET = re.compile(rf"([()\[\]{{}}{SUB_OPEN}{SUB_CLOSE}])")


class Reducer:
    """Groups of one language to characters; equal groups are parsed once."""

    def __init__(self, language: str):
        self.g = GRAMMARS[language]
        self._known: dict[tuple[str, str], str] = {}
        self._opaque = language == "rust"

    def group(self, bracket: str, inner: str) -> str:
        key = (bracket, inner)
        c = self._known.get(key)
        if c is None:
            g = self.g
            s = (g.tidy(inner, bracket) if g.tidy else inner) + END
            mask = sum(1 << k for k, name in enumerate(g.roles[bracket]) if g.rules.whole(name, s))
            # any tokens may be arguments of a Rust macro; elsewhere a group without a role is wrong
            c = chr(BASE[bracket] + mask) if (mask or self._opaque) and BAD not in inner else BAD
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[key] = c
        return c

    def reduce(self, s: str) -> str:
        """Balanced groups replaced, unmatched brackets kept; BAD alone where something can be in no valid text."""
        if BAD in s:
            return BAD
        parts = _BRACKET.split(s)
        done, opened, held = "", [], parts[0]
        for i in range(1, len(parts), 2):
            b, after = parts[i], parts[i + 1]
            if b in BASE:
                opened.append((b, held))
                held = after
            elif opened:
                o, before = opened.pop()
                if o != _CLOSES[b]:
                    return BAD
                c = self.group(o, held)
                if c == BAD:
                    return BAD
                held = before + c + after
            else:
                done += held + b
                held = after
        return done + "".join(before + o for o, before in opened) + held

    def whole(self, s: str) -> bool:
        """Whether a summary is that of a valid text."""
        if BAD in s or _BRACKET.search(s):
            return False
        return self.g.rules.whole(self.g.start, (self.g.tidy(s, "") if self.g.tidy else s) + END)


_REDUCERS: dict[str, Reducer] = {}


def reducer(language: str) -> Reducer:
    if language not in _REDUCERS:
        sys.setrecursionlimit(max(DEPTH, sys.getrecursionlimit()))
        _REDUCERS[language] = Reducer(language)
    return _REDUCERS[language]


#: States that pieces are read from beforehand.
LIKELY = {
    "rust": (CODE, State("comment", "1"), State("string", "\\")),
    "javascript": (CODE, State("comment"), State("template")),
    "typescript": (CODE, State("comment"), State("template")),
    "go": (CODE, State("comment"), State("string", "`")),
}
_SLASH = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*/")


@dataclass
class Summary:
    """What a piece does. ``by`` maps the states it was read from to (state after, bracket summary)."""

    language: str
    text: str
    by: dict[State, tuple[State, str]] = field(default_factory=dict)

    def at(self, state: State, last: bool = False) -> tuple[State, str]:
        """(state after, summary) from a state, read again from the text only where that was not foreseen."""
        plain = self._plain(state)
        if plain in self.by:
            after, s = self.by[plain]
            return (after if plain == state else _shift(state, after)), s
        s, after = LEXERS[self.language].lex(self.text, state, last)
        found = after, reducer(self.language).reduce(s)
        if state == plain:
            self.by[plain] = found
        return found

    def _plain(self, state: State) -> State:
        """The state without what makes no difference to this piece."""
        if self.language not in ("javascript", "typescript"):
            return state
        if SUB_OPEN in state.stack or "k" in state.stack or state.value and _SLASH.match(self.text):
            return state
        return State(state.mode)


def _shift(before: State, after: State) -> State:
    """A state reached from unknown brackets, seen from known ones."""
    closed = int(after.arg or 0)
    kept = before.stack[: len(before.stack) - closed] if closed < len(before.stack) else ""
    return after._replace(stack=kept + after.stack, arg=str(int(before.arg or 0) + max(0, closed - len(before.stack))))


def piece_map(language: str, text: str) -> Summary | Python:
    """The summary of a piece, from every likely state."""
    if language == "python":
        return Python.of(text)
    out = Summary(language, text)
    for state in LIKELY[language]:
        out.at(state)
    return out


def compose(a: Summary | Python, b: Summary | Python) -> Summary | Python:
    """The summary of two neighbours; associative."""
    if isinstance(a, Python):
        return a.then(b)
    out = Summary(a.language, a.text + b.text)
    join = reducer(a.language).reduce
    for state, (mid, s) in a.by.items():
        after, t = b.at(mid)
        out.by[state] = (after, join(s + t))
    return out


def verdict(whole: Summary | Python) -> bool:
    """Whether the text of a composed summary, which starts and must end in code, is valid."""
    if isinstance(whole, Python):
        return whole.valid()
    after, s = whole.at(CODE)
    return after.mode == "code" and reducer(whole.language).whole(s)


# --- Python -------------------------------------------------------------------

_PY_TOKEN = re.compile(
    r"""(?P<skip>[^'"()\[\]{}#\\\n]+|\#[^\n]*|\\.)|(?P<cont>\\\n)|(?P<line>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])"""
    r"""|(?P<long>\"\"\"|''')|(?P<str>"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')|(?P<bad>['"\\])"""
)
_PY_LONG = {q: re.compile(rf"(?:[^\\]|\\[\s\S])*?{q}") for q in ('"""', "'''")}
#: A line that starts a statement of its own at the outermost level.
_PY_START = re.compile(r"(?!(?:else|elif|except|finally)\b)[\w@\"'(\[{*~+\-.]")


def _python(text: str) -> bool:
    """Whether the interpreter's parser takes a text; what exceeds its own limits of nesting it does not take."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _statements(text: str) -> list[int]:
    """Where lines start that begin a statement at the outermost level, read from code outside brackets."""
    starts, at, depth, n, fresh, joined = [], 0, 0, len(text), True, False
    decorated = False
    while at < n:
        if fresh and not depth and not joined and _PY_START.match(text, at):
            if not decorated:
                starts.append(at)
            decorated = text[at] == "@"
        fresh = joined = False
        m = _PY_TOKEN.match(text, at)
        if not m:
            break
        kind, at = m.lastgroup, m.end()
        if kind == "line":
            fresh = True
        elif kind == "cont":
            fresh = joined = True
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif kind == "long":
            end = _PY_LONG[m.group()].match(text, at)
            if not end:
                break
            at = end.end()
        elif kind == "bad":
            break
    return starts


@dataclass
class Python:
    """A piece of Python: text before the first line that can start a statement, and what follows of it that is not parsed yet.

    A piece does not know what its first lines belong to, so they are kept and
    read with the piece before. ``closed`` tells that complete statements were
    parsed between head and tail, ``ok`` that all of them are valid.
    """

    text: str
    known: bool = False
    ok: bool = True

    @staticmethod
    def of(text: str) -> Python:
        return Python(text)

    def _settle(self, start: bool) -> Python:
        """Parses what is complete, given that the text starts outside all brackets and strings."""
        if not self.ok:
            return self
        starts = _statements(self.text)
        if len(starts) < 2:
            return Python(self.text, start, True)
        done, rest = self.text[: starts[-1]], self.text[starts[-1] :]
        cuts = [0, *starts[1:-1], len(done)]
        ok = all(_python(done[a:b]) for a, b in zip(cuts, cuts[1:]))
        return Python(rest, start, ok)

    def then(self, other: Python) -> Python:
        joined = Python(self.text + other.text, self.known, self.ok and other.ok)
        return joined._settle(True) if self.known else joined

    def first(self) -> Python:
        """The piece read as the start of a text."""
        return Python(self.text, True, self.ok)._settle(True)

    def valid(self) -> bool:
        return self.ok and _python(self.text)


# --- Texts ----------------------------------------------------------------------


def prepare(language: str, text: str) -> str:
    """A text without byte-order mark and hashbang, lines ended by ``\\n``."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    if language != "python":
        if text.startswith("#!") and language != "go" and not (language == "rust" and re.match(r"#!\s*\[", text)):
            text = text.partition("\n")[2]
    return text


_CUT = re.compile(r"(?<!\\)\n")


def pieces(text: str, size: int) -> Iterator[str]:
    """Pieces of at least ``size`` characters that end at a line end which no backslash takes back."""
    at = 0
    while at < len(text):
        m = _CUT.search(text, min(at + size, len(text)))
        cut = m.end() if m else len(text)
        yield text[at:cut]
        at = cut


def parses(language: str, text: str, size: int = PIECE) -> bool:
    """Whether a text is valid; blank texts are. Its pieces are read in order, each from the state that the last one left."""
    if not text.strip():
        return True
    text = prepare(language, text)
    if language == "python":
        whole = Python("", True)
        for p in pieces(text, size):
            whole = whole.then(Python.of(p))
        return whole.valid()
    state, s, join = CODE, "", reducer(language).reduce
    for p in pieces(text, size):
        state, t = Summary(language, p).at(state, len(p) == len(text))
        s = join(s + t)
        if s == BAD:
            return False
    return state.mode == "code" and reducer(language).whole(s)
