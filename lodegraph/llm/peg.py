"""Local grammars: rules in a small notation, compiled to matchers over strings of one character per token.

``'fn'`` is a token, ``ID`` a class of tokens, ``$block`` a bracketed group that
is valid as a block, a lower-case name a rule; ``|`` is ordered choice, ``? * +``
repeat, ``&`` and ``!`` look ahead. A choice goes by the next token to the
alternatives that can start with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Matcher = Callable[[str, int], int]
_PART = re.compile(r"'([^']+)'|\$([a-z_]\w*)|([A-Za-z_]\w*)|([()|?*+&!])|\s+")
#: What ends every string that is matched.
END = "\x03"


class Node:
    """kind: set, seq, choice, many, some, maybe, not, and, rule."""

    __slots__ = ("kind", "of")

    def __init__(self, kind: str, of):
        self.kind, self.of = kind, of


class Rules:
    """Rules by name. ``tokens`` gives the character of a token, ``sets`` the characters of a class and of a group's role."""

    def __init__(self, text: str, tokens: dict[str, str], sets: dict[str, frozenset[str]]):
        self.tokens, self.sets = tokens, sets
        self.nodes: dict[str, Node] = {}
        for m in re.finditer(r"^(\w+) =((?:.*)(?:\n[ \t]+.*)*)", text, re.M):
            self.nodes[m.group(1)] = self._read(m.group(2))
        self._first: dict[str, tuple[set[str], bool]] = {n: (set(), False) for n in self.nodes}
        self._settle()
        self._made: dict[str, Matcher] = {}
        for n in self.nodes:
            self._made[n] = self._make(self.nodes[n])

    def _read(self, text: str) -> Node:
        parts = [m.groups() for m in _PART.finditer(text) if m.group().strip()]
        at = 0

        def choice() -> Node:
            nonlocal at
            alternatives = [sequence()]
            while at < len(parts) and parts[at][3] == "|":
                at += 1
                alternatives.append(sequence())
            if all(a.kind == "set" for a in alternatives):
                return Node("set", frozenset().union(*(a.of for a in alternatives)))
            return alternatives[0] if len(alternatives) == 1 else Node("choice", alternatives)

        def sequence() -> Node:
            nonlocal at
            items = []
            while at < len(parts) and parts[at][3] not in ("|", ")"):
                items.append(item())
            return items[0] if len(items) == 1 else Node("seq", items)

        def item() -> Node:
            nonlocal at
            token, role, name, sign = parts[at]
            at += 1
            if sign in ("&", "!"):
                return Node("and" if sign == "&" else "not", item())
            if sign == "(":
                node = choice()
                at += 1
            elif token:
                node = Node("set", frozenset(self.tokens[token]))
            elif role:
                node = Node("set", self.sets.get("$" + role, frozenset()))
            elif name.isupper():
                node = Node("set", self.sets[name])
            else:
                node = Node("rule", name)
            while at < len(parts) and parts[at][3] in ("?", "*", "+"):
                node = Node({"?": "maybe", "*": "many", "+": "some"}[parts[at][3]], node)
                at += 1
            return node

        return choice()

    def first(self, n: Node) -> tuple[set[str], bool]:
        """(characters a match can start with, whether it may be empty)."""
        if n.kind == "set":
            return set(n.of), False
        if n.kind == "rule":
            return self._first[n.of]
        if n.kind == "choice":
            firsts = [self.first(a) for a in n.of]
            return set().union(*(f for f, _ in firsts)), any(e for _, e in firsts)
        if n.kind == "seq":
            out: set[str] = set()
            for x in n.of:
                f, empty = self.first(x)
                out |= f
                if not empty:
                    return out, False
            return out, True
        if n.kind in ("not", "and"):
            return set(), True
        f, empty = self.first(n.of)
        return f, empty or n.kind != "some"

    def _settle(self) -> None:
        changed = True
        while changed:
            changed = False
            for name, node in self.nodes.items():
                new = self.first(node)
                if new != self._first[name]:
                    self._first[name], changed = (set(new[0]), new[1]), True

    def _make(self, n: Node) -> Matcher:
        if n.kind == "set":
            chars = n.of
            return lambda s, i: i + 1 if s[i] in chars else -1
        if n.kind == "rule":
            name, made = n.of, self._made
            return lambda s, i: made[name](s, i)
        if n.kind == "seq":
            steps = tuple(map(self._make, n.of))

            def sequence(s: str, i: int) -> int:
                for p in steps:
                    i = p(s, i)
                    if i < 0:
                        return -1
                return i

            return sequence
        if n.kind == "choice":
            made = [(self._make(a), *self.first(a)) for a in n.of]
            rest = tuple(m for m, _, empty in made if empty)
            starts = set().union(*(f for _, f, _ in made))
            table = {c: tuple(m for m, f, empty in made if empty or c in f) for c in starts}

            def choose(s: str, i: int) -> int:
                for p in table.get(s[i], rest):
                    j = p(s, i)
                    if j >= 0:
                        return j
                return -1

            return choose
        inner = self._make(n.of)
        if n.kind == "not":
            return lambda s, i: i if inner(s, i) < 0 else -1
        if n.kind == "and":
            return lambda s, i: i if inner(s, i) >= 0 else -1
        starts, empty = self.first(n.of)
        if n.kind == "maybe":

            def maybe(s: str, i: int) -> int:
                if s[i] not in starts and not empty:
                    return i
                j = inner(s, i)
                return i if j < 0 else j

            return maybe
        least = n.kind == "some"

        def many(s: str, i: int) -> int:
            if least:
                i = inner(s, i)
                if i < 0:
                    return -1
            while s[i] in starts:
                j = inner(s, i)
                if j <= i:
                    return i
                i = j
            return i

        return many

    def whole(self, name: str, s: str) -> bool:
        """Whether all of ``s``, which ends with END, matches a rule."""
        f, empty = self._first[name]
        if s[0] not in f and not (empty and s[0] == END):
            return False
        return self._made[name](s, 0) == len(s) - 1
