"""Facts of one Rust file: symbols, imports, impl blocks, module declarations, call sites, local bindings, fields.

One pass over the items with a stack of scopes; bodies are scanned for calls and
bindings token by token, macro arguments in () and [] included. Names are not
resolved here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lodegraph.functions.text import fnv1a
from lodegraph.rustlex.lexer import KEYWORDS, Tokens, tokens
from lodegraph.schemas import KIND_TAGS

# fixed values: pointers that a type is seen through, and attributes that make a test
SEEN_THROUGH = ("Box", "Rc", "Arc")
TEST_ATTRIBUTES = ("test", "rstest", "test_case", "proptest", "bench")


@dataclass
class Symbol:
    id: str
    kind: str
    name: str
    qualified_name: str
    start_line: int
    end_line: int
    parent: str | None
    module: str
    visibility: str
    signature: str
    is_test: bool
    fingerprint: str | None
    type_params: list[str] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)
    returns_inner: list[str] = field(default_factory=list)


@dataclass
class Import:
    scope: str
    path: list[str]
    alias: str | None
    glob: bool
    public: bool
    line: int


@dataclass
class Call:
    """kind: path, qualified, method or dynamic. receiver: the parts of a method's receiver, innermost first, as (op, text)."""

    caller: str
    line: int
    kind: str
    path: list[str]
    as_trait: list[str]
    receiver: list[tuple[str, str]]
    text: str


@dataclass
class Impl:
    scope: str
    self_type: list[str]
    trait_path: list[str]
    methods: list[str]
    line: int


@dataclass
class Binding:
    """how: annotated, call, literal or untyped; path: the type or what is called."""

    scope: str
    name: str
    line: int
    how: str
    path: list[str]
    tried: bool = False


@dataclass
class Facts:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    impls: list[Impl] = field(default_factory=list)
    bindings: list[Binding] = field(default_factory=list)
    modules: list[tuple[list[str], str, str | None]] = field(default_factory=list)
    fields: list[tuple[str, str, list[str]]] = field(default_factory=list)
    aliases: list[tuple[str, str, list[str]]] = field(default_factory=list)
    syntax_errors: int = 0
    macro_calls: int = 0


@dataclass
class Scope:
    """Where items are read: the symbol they belong to, their module, and the prefix of their names."""

    owner: str
    module: str
    prefix: str
    test: bool = False
    kind: str = "module"
    inline: tuple[str, ...] = ()


class Reader:
    def __init__(self, text: str, path: str):
        self.t: Tokens = tokens(text)
        self.texts, self.n = self.t.text, len(self.t)
        self.path = path
        self.facts = Facts(syntax_errors=self.t.errors)
        self.ids: set[str] = set()

    # -- helpers ---------------------------------------------------------------

    def at(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.n else ""

    def close(self, i: int) -> int:
        return self.t.partner.get(i, self.n)

    def line(self, i: int) -> int:
        return self.t.line[min(max(i, 0), len(self.t) - 1)] if len(self.t) else 1

    def angles(self, i: int, end: int) -> int:
        """The token after the <...> that opens at i."""
        depth = 0
        while i < end:
            s = self.at(i)
            depth += (s == "<") - (s == ">") - (2 if s == ">>" else 0)
            i = self.close(i) + 1 if s in "([{" and s else i + 1
            if depth <= 0:
                break
        return i

    def words(self, a: int, b: int) -> str:
        """Tokens a to b as one line."""
        out = ""
        for i in range(a, min(b, len(self.t))):
            s = self.at(i)
            tight = not out or s in (",", ";", ":", "::", ".", "(", ")", "[", "]", "<", ">", "?") or out[-1] in "([<&!:." and not out.endswith(": ")
            out += s if tight else " " + s
            if s in (",", ":", "->"):
                out += " "
        return re.sub(r"\s+", " ", out).strip()

    def print_of(self, a: int, b: int, skip: list[tuple[int, int]] = ()) -> str:
        h = 0xCBF29CE484222325
        i = a
        if not skip:
            return f"{fnv1a(b''.join([x.encode() + b'\xff' for x in self.texts[a:b]])):016x}"
        while i < min(b, self.n):
            hole = next((e for s, e in skip if s == i), None)
            if hole is not None:
                i = hole
                continue
            h = fnv1a(self.at(i).encode() + b"\xff", h)
            i += 1
        return f"{h:016x}"

    def path_at(self, i: int, end: int) -> tuple[list[str], int]:
        """A path a::b::<T>::c from i on, and the token after it."""
        parts: list[str] = []
        if self.at(i) == "::":
            parts.append("")
            i += 1
        while i < end and self.t.kind[i] == "id" and (self.at(i) not in KEYWORDS or self.at(i) in ("self", "Self", "super", "crate")):
            parts.append(self.at(i))
            i += 1
            if self.at(i) == "<" and i < end and parts[-1][:1].isupper():
                i = self.angles(i, end)
            if self.at(i) != "::":
                break
            i += 1
            if self.at(i) == "<":
                i = self.angles(i, end)
                if self.at(i) != "::":
                    break
                i += 1
        return parts, i

    def type_at(self, i: int, end: int) -> list[str]:
        """The path of a type, seen through references, pointers, dyn and impl; [] for other types."""
        while i < end and (self.at(i) in ("&", "&&", "mut", "dyn", "impl", "*", "const") or self.t.kind[i] == "life"):
            i += 1
        if i >= end or self.t.kind[i] != "id" and self.at(i) != "::":
            return []
        path, after = self.path_at(i, end)
        if path and path[-1] in SEEN_THROUGH:
            j = i
            while j < after and self.at(j) != "<":
                j += 1
            if j < after:
                return self.type_at(j + 1, after - 1)
        return path

    def first_argument(self, i: int, end: int) -> list[str]:
        """The first type argument of a type, as of Result<T, E>."""
        while i < end and self.at(i) not in ("<", "{", ";", "where", ","):
            i += 1
        return self.type_at(i + 1, end) if self.at(i) == "<" else []

    def add(self, scope: Scope, kind: str, name: str, qualified: str, a: int, b: int, body: int, public: str, test: bool, mark: str | None, **more) -> Symbol:
        base = id = f"{KIND_TAGS[kind]}:{qualified}"
        n = 1
        while id in self.ids:
            n += 1
            id = f"{base}#{n}"
        self.ids.add(id)
        s = Symbol(id, kind, name, qualified, self.line(a), self.line(min(b, len(self.t)) - 1), scope.owner, scope.module, public, self.words(a, body), test, mark, **more)
        self.facts.symbols.append(s)
        return s

    # -- items -----------------------------------------------------------------

    def read(self, module_path: str) -> Facts:
        id = f"mod:{module_path}"
        self.ids.add(id)
        last = self.line(len(self.t) - 1)
        parent = module_path.rpartition("::")[0]
        self.facts.symbols.append(Symbol(id, "module", module_path.rpartition("::")[2], module_path, 1, last, f"mod:{parent}" if parent else None, id, "pub", "", False, None))
        self.items(0, len(self.t), Scope(id, id, module_path))
        return self.facts

    def items(self, i: int, end: int, scope: Scope) -> None:
        while i < end:
            i = max(self.item(i, end, scope), i + 1)

    def item(self, i: int, end: int, scope: Scope) -> int:
        first = i
        test, cfg_test, where = False, False, None
        while self.at(i) == "#" and i < end:
            j = i + 2 if self.at(i + 1) == "!" else i + 1
            if self.at(j) != "[":
                break
            inner = self.words(j + 1, self.close(j))
            name = re.split(r"[(\s=]", inner, maxsplit=1)[0].rpartition("::")[2]
            test |= name in TEST_ATTRIBUTES
            cfg_test |= inner.startswith("cfg") and bool(re.search(r"\btest\b", inner)) and "not(test" not in inner.replace(" ", "")
            if inner.startswith("path"):
                where = inner.partition('"')[2].rpartition('"')[0]
            i = self.close(j) + 1
        start = i
        public = "private"
        if self.at(i) == "pub":
            public = "pub"
            i += 1
            if self.at(i) == "(" and self.at(i + 1) in ("crate", "super", "self", "in"):
                public = f"pub({self.words(i + 1, self.close(i))})"
                i = self.close(i) + 1
        while self.at(i) in ("const", "async", "unsafe", "extern", "default", "static") and (self.at(i + 1) in ("fn", "async", "unsafe", "extern", "trait", "impl") or self.at(i) == "extern" and self.t.kind[min(i + 1, len(self.t) - 1)] == "str"):
            i += 2 if self.at(i) == "extern" and self.t.kind[min(i + 1, len(self.t) - 1)] == "str" else 1
        word = self.at(i)
        test_here = scope.test or cfg_test
        if word == "use":
            stop = self.until(i, end, ";")
            self.use(i + 1, stop, [], scope, public != "private", self.line(i))
            return stop + 1
        if word == "mod" and i + 1 < end:
            name = self.at(i + 1)
            if self.at(i + 2) != "{":
                self.facts.modules.append((list(scope.inline), name, where))
                return i + 3
            stop = self.close(i + 2)
            s = self.add(scope, "module", name, f"{scope.prefix}::{name}", start, stop + 1, i + 2, public, False, None)
            s.module = s.id
            self.items(i + 3, stop, Scope(s.id, s.id, s.qualified_name, test_here, "module", (*scope.inline, name)))
            return stop + 1
        if word == "fn":
            return self.function(i, start, end, scope, public, test, test_here)
        if word in ("struct", "enum", "trait", "union") and i + 1 < end and self.t.kind[i + 1] == "id":
            return self.type_item("struct" if word == "union" else word, i, start, end, scope, public, test_here)
        if word == "impl":
            return self.impl(i, end, scope, test_here)
        if word == "type" and i + 1 < end:
            stop = self.until(i, end, ";")
            eq = next((j for j in range(i, stop) if self.at(j) == "="), None)
            if eq:
                self.facts.aliases.append((scope.owner, self.at(i + 1), self.type_at(eq + 1, stop)))
            return stop + 1
        if word == "extern" and self.at(i + 1) == "crate":
            stop = self.until(i, end, ";")
            name = self.at(i + 2)
            self.facts.imports.append(Import(scope.owner, ["", name], self.at(i + 4) if self.at(i + 3) == "as" else name, False, public != "private", self.line(i)))
            return stop + 1
        if self.at(i + 1) == "!" and word == "macro_rules":
            return self.skip_braces(i + 2, end)
        if word in ("const", "static"):
            stop = self.until(i, end, ";")
            self.body(i + 1, stop, scope.owner, scope)
            return stop + 1
        if i < end and self.t.kind[i] == "id" and self.at(i + 1) == "!":
            self.facts.macro_calls += 1
            return self.skip_braces(i + 2, end)
        return self.close(i) + 1 if self.at(i) in ("(", "[", "{") else max(i, first) + 1

    def until(self, i: int, end: int, mark: str) -> int:
        """The first mark outside brackets."""
        while i < end and self.at(i) != mark:
            i = self.close(i) + 1 if self.at(i) in ("(", "[", "{") else i + 1
        return min(i, end)

    def skip_braces(self, i: int, end: int) -> int:
        while i < end and self.at(i) not in ("(", "[", "{"):
            i += 1
        i = self.close(i) + 1
        return i + 1 if self.at(i) == ";" else i

    def generics(self, i: int, end: int) -> tuple[list[str], int]:
        if self.at(i) != "<":
            return [], i
        stop = self.angles(i, end)
        names, depth = [], 0
        for j in range(i, stop):
            s = self.at(j)
            depth += (s == "<") - (s == ">")
            if depth == 1 and self.at(j - 1) in ("<", ",") and self.t.kind[j] == "id" and s != "const":
                names.append(s)
        return names, stop

    def function(self, i: int, start: int, end: int, scope: Scope, public: str, test: bool, test_here: bool, owner: tuple[str, str] | None = None) -> int:
        name = self.at(i + 1)
        params, j = self.generics(i + 2, end)
        if self.at(j) != "(":
            return i + 2
        close = self.close(j)
        k = close + 1
        returns: list[str] = []
        inner: list[str] = []
        if self.at(k) == "->":
            returns = self.type_at(k + 1, end)
            inner = self.first_argument(k + 1, end)
        while k < end and self.at(k) not in ("{", ";"):
            k = self.close(k) + 1 if self.at(k) in ("(", "[") else k + 1
        stop = self.close(k) + 1 if self.at(k) == "{" else k + 1
        kind, qualified = ("method", f"{owner[1]}::{name}") if owner else ("function", f"{scope.prefix}::{name}")
        s = self.add(scope, kind, name, qualified, start, stop, k, public, test, self.print_of(i, stop), type_params=params, returns=returns, returns_inner=inner)
        if owner:
            s.parent = owner[0]
        self.parameters(j + 1, close, s.id, self.line(j))
        if self.at(k) == "{":
            self.body(k + 1, self.close(k), s.id, Scope(s.id, scope.module, qualified, test_here, "function", scope.inline))
        return stop

    def parameters(self, i: int, end: int, id: str, line: int) -> None:
        while i < end:
            stop = self.until(i, end, ",")
            colon = self.until(i, stop, ":")
            names = [self.at(j) for j in range(i, colon) if self.t.kind[j] == "id" and self.at(j) not in KEYWORDS]
            if colon < stop and len(names) == 1:
                self.facts.bindings.append(Binding(id, names[0], line, "annotated" if self.type_at(colon + 1, stop) else "untyped", self.type_at(colon + 1, stop)))
            i = stop + 1

    def type_item(self, kind: str, i: int, start: int, end: int, scope: Scope, public: str, test_here: bool) -> int:
        name = self.at(i + 1)
        params, j = self.generics(i + 2, end)
        while j < end and self.at(j) not in ("{", ";"):
            j = self.close(j) + 1 if self.at(j) in ("(", "[") else j + 1
        stop = self.close(j) + 1 if self.at(j) == "{" else j + 1
        s = self.add(scope, kind, name, f"{scope.prefix}::{name}", start, stop, j, public, False, None if kind == "trait" else self.print_of(i, stop), type_params=params)
        if kind == "trait":
            holes = self.members(j + 1, self.close(j), Scope(s.id, scope.module, s.qualified_name, test_here, "trait", scope.inline), (s.id, s.qualified_name), []) if self.at(j) == "{" else []
            s.fingerprint = self.print_of(i, stop, holes)
        elif kind == "struct" and self.at(j) == "{":
            a = j + 1
            while a < self.close(j):
                b = self.until(a, self.close(j), ",")
                colon = self.until(a, b, ":")
                if colon < b and self.t.kind[colon - 1] == "id":
                    self.facts.fields.append((s.id, self.at(colon - 1), self.type_at(colon + 1, b)))
                a = b + 1
        return stop

    def members(self, i: int, end: int, scope: Scope, owner: tuple[str, str], methods: list[str]) -> list[tuple[int, int]]:
        """Reads the methods of a trait or impl; gives their token ranges."""
        ranges = []
        while i < end:
            first, test = i, False
            while self.at(i) == "#" and self.at(i + 1) == "[":
                test |= self.at(i + 2) in TEST_ATTRIBUTES
                i = self.close(i + 1) + 1
            start, public = i, "private"
            while i < end and self.at(i) in ("pub", "const", "async", "unsafe", "extern", "default") or self.t.kind[min(i, len(self.t) - 1)] == "str" and i < end:
                if self.at(i) == "pub":
                    public = "pub"
                i += 1
                if self.at(i) == "(" and self.at(i - 1) == "pub":
                    i = self.close(i) + 1
            if self.at(i) == "fn":
                before = len(self.facts.symbols)
                stop = self.function(i, start, end, scope, public, test, scope.test, owner)
                # none where the text ends before the method's parameters
                methods += [s.id for s in self.facts.symbols[before : before + 1]]
                ranges.append((first, stop))
                i = stop
            elif self.at(i) in ("(", "[", "{"):
                i = self.close(i) + 1
            else:
                i += 1
        return ranges

    def impl(self, i: int, end: int, scope: Scope, test_here: bool) -> int:
        line = self.line(i)
        params, j = self.generics(i + 1, end)
        body = j
        while body < end and self.at(body) not in ("{", ";"):
            body = self.close(body) + 1 if self.at(body) in ("(", "[") else body + 1
        split = next((k for k in range(j, body) if self.at(k) == "for" and self.at(k + 1) != "<"), None)
        where = next((k for k in range(j, body) if self.at(k) == "where"), body)
        trait: list[str] = []
        a = j
        if split is not None:
            trait, a = self.type_at(j + (self.at(j) == "!"), split), split + 1
        own = self.type_at(a, where)
        name = own[-1] if own else self.words(a, where)
        text = self.words(j, split) if split is not None else ""
        prefix = f"{scope.prefix}::<{name} as {text.rpartition('::')[2] if '<' not in text else text}>" if split is not None else f"{scope.prefix}::{name}"
        methods: list[str] = []
        if self.at(body) == "{":
            anchor = f"impl:{scope.prefix}:{line}:{i}"
            inner = Scope(scope.owner, scope.module, scope.prefix, test_here, "impl", scope.inline)
            self.members(body + 1, self.close(body), inner, (anchor, prefix), methods)
            for s in self.facts.symbols:
                if s.parent == anchor:
                    s.type_params = [*s.type_params, *params]
                    s.parent = next((x.id for x in self.facts.symbols if x.kind in ("struct", "enum") and x.qualified_name == f"{scope.prefix}::{name}"), scope.owner)
            self.facts.impls.append(Impl(scope.owner, own, trait, methods, line))
            return self.close(body) + 1
        return body + 1

    def use(self, i: int, end: int, prefix: list[str], scope: Scope, public: bool, line: int) -> None:
        path = list(prefix)
        if self.at(i) == "::" and not prefix:
            path.append("")
            i += 1
        while i < end:
            s = self.at(i)
            if s == "{":
                a, stop = i + 1, self.close(i)
                while a < stop:
                    b = self.until(a, stop, ",")
                    if b > a:
                        self.use(a, b, path, scope, public, line)
                    a = b + 1
                return
            if s == "*":
                self.facts.imports.append(Import(scope.owner, path, None, True, public, line))
                return
            if s == "as":
                self.facts.imports.append(Import(scope.owner, path, self.at(i + 1), False, public, line))
                return
            if s == "self" and prefix and self.at(i - 1) != "::":
                pass
            elif s != "::":
                path.append(s)
            i += 1
        if path and path != prefix or path == prefix and prefix:
            self.facts.imports.append(Import(scope.owner, path, None, False, public, line))

    # -- bodies ----------------------------------------------------------------

    def body(self, i: int, end: int, caller: str, scope: Scope) -> None:
        """Calls and bindings between two tokens; items inside are read on their own."""
        while i < end:
            s, kind = self.at(i), self.t.kind[i]
            before = self.at(i - 1)
            if s in ("fn", "struct", "enum", "trait", "impl", "mod", "use") and before in ("{", "}", ";", "]", "pub", "async", "unsafe", "const", ""):
                if s == "impl" or self.t.kind[min(i + 1, len(self.t) - 1)] == "id" or s == "use":
                    i = max(self.item(i, end, scope), i + 1)
                    continue
            if s == "macro_rules" and self.at(i + 1) == "!":
                i = self.skip_braces(i + 2, end)
                continue
            if kind == "id" and self.at(i + 1) == "!" and self.at(i + 2) in ("(", "[", "{"):
                self.facts.macro_calls += 1
                i = self.close(i + 2) + 1 if self.at(i + 2) == "{" else i + 3
                continue
            if s == "let":
                self.let(i, end, caller)
            elif s == "|" or s == "||":
                i = self.closure(i, end, caller)
                continue
            elif s == "." and i + 1 < end and self.t.kind[i + 1] == "id":
                j = i + 2
                if self.at(j) == "::" and self.at(j + 1) == "<":
                    j = self.angles(j + 1, end)
                if self.at(j) == "(":
                    receiver = self.receiver(i)
                    self.facts.calls.append(Call(caller, self.line(i + 1), "method", [self.at(i + 1)], [], receiver, f"{self.shown(receiver)}.{self.at(i + 1)}"))
                i += 2
                continue
            elif s == "<" and before not in (")", "]", "::") and self.t.kind[i - 1] not in ("id", "num") and (q := self.qualified(i, end)):
                path, as_trait, after = q
                if self.at(after) == "(":
                    self.facts.calls.append(Call(caller, self.line(i), "qualified", path, as_trait, [], self.words(i, after)))
                i = after
                continue
            elif s == "(" and before == ")" and self.line(i) == self.line(i - 1) and self.is_value(i - 1):
                a = self.open_of(i - 1)
                self.facts.calls.append(Call(caller, self.line(i), "dynamic", [], [], [], self.words(a, i)))
            elif (kind == "id" and (s not in KEYWORDS or s in ("self", "Self", "super", "crate")) or s == "::") and before not in (".", "::") and self.at(i + 1) != "!":
                path, j = self.path_at(i, end)
                if path and self.at(j) == "(" and path[-1] not in ("self", "super", "crate"):
                    self.facts.calls.append(Call(caller, self.line(i), "path", path, [], [], "::".join(path)))
                i = max(j, i + 1)
                continue
            i += 1

    def is_value(self, i: int) -> bool:
        """Whether the parenthesis that closes at i ends a value, as in (f())(x) or f(x)(y); types such as Fn(A) do not."""
        a = self.open_of(i)
        before = self.at(a - 1)
        return self.at(i) == ")" and not before[:1].isupper() and before not in ("if", "while", "match", "for", "fn", "in", "!", "pub")

    def open_of(self, i: int) -> int:
        return self.t.partner.get(i, i)

    def qualified(self, i: int, end: int) -> tuple[list[str], list[str], int] | None:
        stop = self.angles(i, end)
        split = next((k for k in range(i, stop) if self.at(k) == "as"), None)
        if split is None or self.at(stop) != "::":
            return None
        name, after = self.path_at(stop + 1, end)
        return self.type_at(i + 1, split) + name, self.type_at(split + 1, stop - 1), after

    def receiver(self, dot: int) -> list[tuple[str, str]]:
        """What stands before a dot, innermost part first."""
        i = dot - 1
        if self.at(i) == "?":
            return [*self.receiver(i), ("try", "?")]
        if self.at(i) == ")":
            a = self.open_of(i)
            j = a - 1
            if self.at(j) == ">" :
                depth = 0
                while j > 0:
                    depth += (self.at(j) == ">") - (self.at(j) == "<")
                    j -= 1
                    if not depth:
                        break
                j -= self.at(j) == "::"
            if j >= 0 and self.t.kind[j] == "id" and self.at(j) not in KEYWORDS - {"self", "Self", "super", "crate"}:
                if self.at(j - 1) == ".":
                    return [*self.receiver(j - 1), ("method", self.at(j))]
                parts = [self.at(j)]
                while self.at(j - 1) == "::" and self.t.kind[j - 2] == "id":
                    parts.insert(0, self.at(j - 2))
                    j -= 2
                return [("call", "::".join(parts))]
            return [("expr", self.words(a, i + 1)[:60])]
        if self.at(i) == "self":
            return [("self", "self")]
        if self.t.kind[i] == "id":
            if self.at(i - 1) == "." and self.at(i - 2) == "self" and self.at(i - 3) != ".":
                return [("field", self.at(i))]
            if self.at(i - 1) not in (".", "::"):
                return [("variable", self.at(i))]
        return [("expr", self.at(i)[:60])]

    @staticmethod
    def shown(parts: list[tuple[str, str]]) -> str:
        out = ""
        for op, text in parts:
            out = {"field": f"self.{text}", "method": f"{out}.{text}()", "try": f"{out}?", "call": f"{text}()"}.get(op, text)
        return out

    def let(self, i: int, end: int, caller: str) -> None:
        j = i + 1 + (self.at(i + 1) == "mut")
        stop = self.until(i, end, ";")
        if self.at(i - 1) in ("if", "while", "&&"):
            return
        if self.t.kind[min(j, len(self.t) - 1)] != "id" or self.at(j + 1) not in (":", "=", ";"):
            for k in range(j, self.until(j, stop, "=")):
                if self.t.kind[k] == "id" and self.at(k) not in KEYWORDS and self.at(k)[:1].islower() and self.at(k + 1) not in ("::", "(", "{", "!"):
                    self.facts.bindings.append(Binding(caller, self.at(k), self.line(k), "untyped", []))
            return
        name, line = self.at(j), self.line(j)
        eq = self.until(j, stop, "=")
        if self.at(j + 1) == ":":
            path = self.type_at(j + 2, eq)
            self.facts.bindings.append(Binding(caller, name, line, "annotated" if path else "untyped", path))
            return
        a = eq + 1
        while self.at(a) in ("&", "mut", "*"):
            a += 1
        path, after = self.path_at(a, stop) if a < stop and (self.t.kind[a] == "id" or self.at(a) == "::") else ([], a)
        if path and self.at(after) == "(":
            close = self.close(after)
            rest = self.at(close + 1)
            if rest in (";", "?") and self.at(close + (2 if rest == "?" else 1)) in (";", ""):
                self.facts.bindings.append(Binding(caller, name, line, "call", path, rest == "?"))
                return
        if path and self.at(after) == "{" and path[-1][:1].isupper():
            self.facts.bindings.append(Binding(caller, name, line, "literal", path))
            return
        self.facts.bindings.append(Binding(caller, name, line, "untyped", []))

    def closure(self, i: int, end: int, caller: str) -> int:
        if self.at(i) == "||" or self.at(i - 1) not in ("(", ",", "=", "move", "{", ";", "return", "=>", ""):
            return i + 1
        stop = i + 1
        while stop < end and self.at(stop) != "|":
            stop = self.close(stop) + 1 if self.at(stop) in ("(", "[", "{") else stop + 1
        for k in range(i + 1, min(stop, end)):
            if self.t.kind[k] == "id" and self.at(k) not in KEYWORDS and self.at(k - 1) in ("|", ",", "&", "mut", "("):
                typed = self.at(k + 1) == ":"
                path = self.type_at(k + 2, self.until(k, stop, ",")) if typed else []
                self.facts.bindings.append(Binding(caller, self.at(k), self.line(k), "annotated" if path else "untyped", path))
        return stop + 1


def read_file(text: str, path: str, module_path: str) -> Facts:
    """The facts of one file whose file module is ``module_path``."""
    return Reader(text, path).read(module_path)
