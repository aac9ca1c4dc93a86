"""What names mean in the scopes of one repository, as the least solution of its imports and aliases.

Every import and alias is an equation: what it binds is what its path leads to.
All start empty and are worked out again in rounds until none changes, so chains
of re-exports of any length are followed and circles of imports bind nothing.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from lodegraph.rustlex.items import Facts, Import, Symbol

TYPE_KINDS = ("struct", "enum", "trait")
CALLED_KINDS = ("function", "method")
NOTHING: frozenset[str] = frozenset()


class Walk(NamedTuple):
    """Where a path leads. ``at`` is the segment that was not there, the length of the path where all were; ``owner`` the type that lacks the last one; ``outside`` that it left the repository."""

    targets: frozenset[str] = NOTHING
    via: str = "path"
    at: int = 0
    owner: str | None = None
    outside: bool = False


class Index:
    """The facts of a repository by what they are looked up by. files: path -> (facts, crate, target kind)."""

    def __init__(self, files: dict[str, tuple[Facts, str, str]]):
        self.symbols: dict[str, Symbol] = {}
        self.crate: dict[str, str] = {}
        self.roots: dict[str, str] = {}
        self.below: dict[tuple[str, str], list[Symbol]] = defaultdict(list)
        self.named: dict[tuple[str, str], list[Import]] = defaultdict(list)
        self.globs: dict[str, list[Import]] = defaultdict(list)
        self.fields: dict[tuple[str, str], list[str]] = {}
        self.aliases: dict[tuple[str, str], list[str]] = {}
        self.bindings: dict[tuple[str, str], list] = defaultdict(list)
        self.imports: list[Import] = []
        for path in sorted(files):
            facts, crate, target = files[path]
            for s in facts.symbols:
                self.symbols.setdefault(s.id, s)
                self.crate[s.id] = crate
                if s.parent:
                    self.below[s.parent, s.name].append(s)
            if target == "lib" and facts.symbols[0].id == f"mod:{crate}":
                self.roots[crate] = facts.symbols[0].id
            self.imports += facts.imports
            self.fields |= {(owner, name): t for owner, name, t in facts.fields}
            self.aliases |= {(scope, name): t for scope, name, t in facts.aliases}
            for b in facts.bindings:
                self.bindings[b.scope, b.name].append(b)
        for i in self.imports:
            if i.glob:
                self.globs[i.scope].append(i)
            elif i.alias or i.path:
                self.named[i.scope, i.alias or i.path[-1]].append(i)

    def kind(self, id: str | None) -> str:
        return self.symbols[id].kind if id in self.symbols else ""

    def chain(self, id: str | None, step) -> list[Symbol]:
        """A symbol and what ``step`` gives of it, again and again."""
        out, seen = [], set()
        while id in self.symbols and id not in seen:
            seen.add(id)
            out.append(self.symbols[id])
            id = step(self.symbols[id])
        return out

    def written_in(self, id: str) -> list[Symbol]:
        """A symbol and its parents up to the first module."""
        return self.chain(id, lambda s: None if s.kind == "module" else s.parent)

    def scopes(self, id: str) -> list[Symbol]:
        """The scopes whose names a scope sees without a path: enclosing functions, then the module."""
        return self.chain(id, lambda s: None if s.kind == "module" else s.parent if self.kind(s.parent) in CALLED_KINDS else s.module)

    def module_of(self, id: str) -> str | None:
        s = self.symbols.get(id)
        return None if s is None else s.id if s.kind == "module" else s.module

    def contains(self, module: str, id: str) -> bool:
        return any(s.id == module for s in self.chain(self.module_of(id), lambda s: s.parent))

    def self_type(self, id: str) -> str | None:
        for s in self.written_in(id):
            if s.kind in TYPE_KINDS:
                return s.id
            if s.kind == "method" and self.kind(s.parent) in TYPE_KINDS:
                return s.parent
        return None

    def is_parameter(self, id: str, name: str) -> bool:
        return any(name in s.type_params for s in self.written_in(id) if s.kind != "module")


class NameTable:
    """The solution. ``members`` gives what a type has under a name, which impl blocks decide (``link``)."""

    def __init__(self, index: Index):
        self.index = index
        self.bound: dict[tuple[int, bool], frozenset[str]] = {}
        self.alias: dict[tuple[str, str], frozenset[str]] = {}
        self.left: set[int] = set()
        self._numbers = {id(i): n for n, i in enumerate(index.imports)}
        self.of_traits: set[str] = set()
        self.traits_of: dict[str, list[str]] = defaultdict(list)
        self.solve()

    def solve(self) -> None:
        """Rounds over all equations; a repository with n of them settles in n rounds at most, or leaves what goes in circles as it is."""
        imports = list(enumerate(self.index.imports))
        for _ in range(len(imports) + len(self.index.aliases) + 1):
            before = dict(self.bound), dict(self.alias)
            for n, i in imports:
                for value in (False,) if i.glob else (False, True):
                    self.bound[n, value] = self.walk(i.scope, i.path, value).targets
            for (scope, name), path in self.index.aliases.items():
                self.alias[scope, name] = self.walk(scope, path, False).targets
            if before == (self.bound, self.alias):
                break
        while more := {n for n, i in imports if n not in self.left and self._leaves(i)}:
            self.left |= more

    def _at(self, i: Import, value: bool) -> frozenset[str]:
        return self.bound.get((self._numbers[id(i)], value), NOTHING)

    def _leaves(self, i: Import) -> bool:
        """Whether an import names something outside: its first segment is unknown, or it passes what leads outside."""
        walks = [self.walk(i.scope, i.path, value) for value in ((False,) if i.glob else (False, True))]
        if any(w.outside for w in walks):
            return True
        return not any(w.targets or w.owner for w in walks) and not any(w.at for w in walks)

    def import_leaves(self, i: Import) -> bool:
        return self._numbers[id(i)] in self.left

    def leads_outside(self, module: str, name: str) -> bool:
        return any(self.import_leaves(i) for i in self.index.named.get((module, name), ())) or (module, name) in self.index.aliases and not self.alias.get((module, name))

    def here(self, scope: str, name: str, value: bool, private: bool) -> tuple[frozenset[str], str]:
        """(targets, via) that a scope itself gives a name: its items, aliases and named imports, else what its globs bring in.

        Globs are followed through further globs; ``private`` ones and imports
        count where the asking scope lies within.
        """
        x, todo, seen, found = self.index, [(scope, private)], set(), set()
        while todo:
            at, inner = todo.pop()
            if (at, inner) in seen:
                continue
            seen.add((at, inner))
            own = {s.id for s in x.below.get((at, name), ()) if (s.kind == "function" if value else s.kind in (*TYPE_KINDS, "module"))}
            if not own and not value:
                own = set(self.alias.get((at, name), NOTHING))
            via = "scope" if own else "import"
            if not own:
                own = {t for i in x.named.get((at, name), ()) if inner or i.public for t in self._at(i, value)}
            if own and at == scope:
                return frozenset(own), via
            found |= own
            if not own:
                todo += [(m, x.contains(m, at)) for i in x.globs.get(at, ()) if inner or i.public for m in self._at(i, False) if x.kind(m) == "module"]
        return frozenset(found), "import"

    def visible(self, scope: str, name: str, value: bool) -> tuple[frozenset[str], str]:
        """(targets, via) of a name without a path: the nearest scope that has it, else another crate's root."""
        for s in self.index.scopes(scope):
            found = self.here(s.id, name, value, True)
            if found[0]:
                return found
        root = self.index.roots.get(name)
        if root and not value and self.index.crate.get(root) != self.index.crate.get(scope):
            return frozenset((root,)), "path"
        return NOTHING, ""

    def members(self, owner: str, name: str) -> list[str]:
        """Callable members of a type: its own, before those of its trait impls, before what its traits provide."""
        x = self.index
        direct = [s.id for s in x.below.get((owner, name), ()) if s.kind == "method"]
        if x.kind(owner) != "trait":
            provided = [s.id for t in self.traits_of.get(owner, ()) for s in x.below.get((t, name), ()) if s.kind == "method"]
            direct = [m for m in direct if m not in self.of_traits] or direct or provided
        return direct

    def _start(self, scope: str, path: list[str], value: bool) -> tuple[frozenset[str], str, int] | Walk:
        """(targets, via, segments used) of the start of a path, or where it ends there."""
        x, head = self.index, path[0]
        if head == "Self":
            own = x.self_type(scope)
            return (frozenset((own,)), "self_type", 1) if own else Walk()
        if head == "":
            root = x.roots.get(path[1]) if len(path) > 1 else None
            return (frozenset((root,)), "path", 2) if root else Walk(outside=True)
        if head in ("self", "super"):
            module, used = x.module_of(scope), int(head == "self")
            while module and used < len(path) and path[used] == "super":
                up = x.symbols[module].parent if module in x.symbols else None
                if up not in x.symbols:
                    return Walk(at=used)
                module, used = x.module_of(up), used + 1
            return (frozenset((module,)), "path", used) if module else Walk()
        if head == "crate":
            root = f"mod:{x.crate.get(scope)}"
            return (frozenset((root,)), "path", 1) if root in x.symbols else Walk()
        found, via = self.visible(scope, head, value and len(path) == 1)
        return (found, via, 1) if found else Walk()

    def walk(self, scope: str, path: list[str], value: bool) -> Walk:
        """Follows a path from a scope; its last segment is a callable where ``value``, else a type or module."""
        began = self._start(scope, path, value) if path else Walk()
        if isinstance(began, Walk):
            return began
        x, (current, via, at) = self.index, began
        for at in range(at, len(path)):
            last, name, step, owner = at == len(path) - 1, path[at], set(), None
            for t in sorted(current):
                if x.kind(t) == "module":
                    more = self.here(t, name, value and last, x.contains(t, scope))[0]
                    if not more and self.leads_outside(t, name):
                        return Walk(outside=True)
                    step |= more
                elif x.kind(t) in TYPE_KINDS:
                    more = self.members(t, name) if value and last else ()
                    owner = owner or (None if more else t)
                    step.update(more)
            if not step:
                return Walk(via=via, at=at, owner=owner if last else None)
            current = frozenset(step)
        return Walk(current, via, len(path))

    def only(self, scope: str, path: list[str], kinds: tuple[str, ...]) -> str | None:
        """The one symbol of these kinds that a path leads to."""
        t = self.walk(scope, path, False).targets
        return next(iter(t)) if len(t) == 1 and self.index.kind(next(iter(t))) in kinds else None
