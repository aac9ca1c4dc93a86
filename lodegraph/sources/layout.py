"""Packages, build targets and module paths of a Rust repository."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

# fixed values: kinds of targets, in the order in which they claim files
TARGET_KINDS = ("lib", "bin", "build", "test", "example", "bench")


@dataclass(frozen=True)
class Target:
    package: str
    name: str
    kind: str
    root: str


def parse_manifest(text: str) -> tuple[str, list[tuple[str, str | None, str | None]]] | None:
    """(package name, explicit targets as (kind, name, path)); None for a manifest without a package."""
    try:
        m = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    name = m.get("package", {}).get("name")
    if not isinstance(name, str):
        return None
    found = [("lib", m["lib"].get("name"), m["lib"].get("path"))] if isinstance(m.get("lib"), dict) else []
    for kind in ("bin", "test", "example", "bench"):
        found += [(kind, t.get("name"), t.get("path")) for t in m.get(kind, []) if isinstance(t, dict)]
    return name, found


def dependency_names(text: str) -> list[str]:
    """Names of all dependencies: plain, dev, build, of targets and of the workspace."""
    try:
        m = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    tables = [m, m.get("workspace", {}), *m.get("target", {}).values()]
    return sorted({n.replace("-", "_") for t in tables if isinstance(t, dict) for k, v in t.items() if k.endswith("dependencies") and isinstance(v, dict) for n in v})


def owner(path: str, folders: list[str]) -> str | None:
    """The deepest package folder that holds a path; "" holds all."""
    held = [f for f in folders if not f or path.startswith(f + "/")]
    return max(held, key=len, default=None)


def _packages(manifests: dict[str, str]) -> dict[str, tuple[str, list]]:
    """Folder -> (package name, explicit targets)."""
    return {p.rpartition("/")[0]: m for p, text in manifests.items() if (m := parse_manifest(text))}


def targets(repo: str, manifests: dict[str, str], files: list[str]) -> list[Target]:
    """Build targets from manifests (path -> text) and conventions; a repository without manifests is one package of its name."""
    there = set(files)
    packages = _packages(manifests) or {"": (repo, [])}
    out: dict[tuple[str, str], Target] = {}

    def add(package: str, kind: str, name: str, root: str) -> None:
        if root in there:
            out.setdefault((package, root), Target(package, name.replace("-", "_"), kind, root))

    for folder, (name, explicit) in packages.items():
        at = lambda p: f"{folder}/{p}" if folder else p  # noqa: B023, E731
        own = [f for f in files if owner(f, list(packages)) == folder]
        for kind, given, path in explicit:
            default = {"lib": "src/lib.rs", "bin": f"src/bin/{given}.rs", "test": f"tests/{given}.rs", "example": f"examples/{given}.rs", "bench": f"benches/{given}.rs"}[kind]
            add(name, kind, given or name, at(path or default))
        add(name, "lib", name, at("src/lib.rs"))
        add(name, "bin", name, at("src/main.rs"))
        add(name, "build", "build_script", at("build.rs"))
        for kind, where in (("bin", "src/bin/"), ("test", "tests/"), ("example", "examples/"), ("bench", "benches/")):
            for f in own:
                rest = f.removeprefix(at(where))
                if rest != f and rest.endswith(".rs") and ("/" not in rest or rest.count("/") == 1 and rest.endswith("/main.rs")):
                    add(name, kind, rest.removesuffix("/main.rs").removesuffix(".rs"), f)
    return sorted(out.values(), key=lambda t: (TARGET_KINDS.index(t.kind), t.name, t.root))


def child_file(file: str, is_root: bool, inline: list[str], name: str, path: str | None, there: set[str]) -> str | None:
    """The file of ``mod name;`` in a file: as its #[path] says, else name.rs or name/mod.rs in the folder that the file owns."""
    folder, _, base = file.rpartition("/")
    if path is not None:
        return next((p for p in (_join(folder, path),) if p in there), None)
    own = folder if is_root or base == "mod.rs" else _join(folder, base.removesuffix(".rs"))
    for part in inline:
        own = _join(own, part)
    return next((p for p in (_join(own, f"{name}.rs"), _join(own, f"{name}/mod.rs")) if p in there), None)


def module_segments(parts: list[str], at_root: bool) -> list[str]:
    """Module names of a path: a/b.rs is a, b and a/mod.rs is a; lib.rs and main.rs of a target's own folder are its root."""
    *above, last = parts
    stem = last.removesuffix(".rs")
    own = [] if stem == "mod" or at_root and not above and stem in ("lib", "main") else [stem]
    return [x.replace("-", "_") for x in (*above, *own)]


def _convention(package: str, rest: str, has_lib: bool, has_main: bool) -> tuple[str, str, str, list[str]]:
    """(target, kind, root, module segments) of a path below its package's folder."""
    match rest.split("/"):
        case ["build.rs"]:
            return f"{package}_build", "build", rest, []
        case ["src", "main.rs"]:
            return f"{package}_bin" if has_lib else package, "bin", rest, []
        case ["src", "bin", *below] | [("tests" | "examples" | "benches"), *below] if below:
            where = rest.removesuffix("/" + "/".join(below))
            kind = {"src/bin": "bin", "tests": "test", "examples": "example", "benches": "bench"}[where]
            if len(below) == 1:
                return below[0].removesuffix(".rs"), kind, rest, []
            return below[0], kind, f"{where}/{below[0]}/main.rs", module_segments(below[1:], True)
        case ["src", *below] if below:
            return (package, "lib", "src/lib.rs", module_segments(below, True)) if has_lib or not has_main else (package, "bin", "src/main.rs", module_segments(below, True))
        case parts:
            return package, "lib", "", module_segments(parts, False)


def by_path(repo: str, manifests: dict[str, str], files: list[str]) -> dict[str, tuple[Target, str]]:
    """file -> (target, module path) of every file, from its path alone; files outside all packages belong to one of the repository's name."""
    packages, there, out = _packages(manifests), set(files), {}
    for f in files:
        folder = owner(f, list(packages))
        name, explicit = packages.get(folder, (repo, []))
        start = f"{folder}/" if folder else ""
        rest = f.removeprefix(start)
        given = [(kind, target or name, _join("", path)) for kind, target, path in explicit if path]
        root = next((g for g in given if g[2] == rest), None)
        # a folder that only an explicit target names holds that target's modules
        usual = {"lib": ("src/lib.rs",), "bin": ("src/main.rs", "src/bin/"), "test": ("tests/",), "example": ("examples/",), "bench": ("benches/",)}
        held = [g for g in given if not g[2].startswith(usual[g[0]]) and "/" in g[2] and rest.startswith(g[2].rpartition("/")[0] + "/")]
        if root:
            kind, target, at, segments = *root, []
        elif held:
            kind, target, at = max(held, key=lambda g: g[2].count("/"))
            segments = module_segments(rest.removeprefix(at.rpartition("/")[0] + "/").split("/"), False)
        else:
            target, kind, at, segments = _convention(name, rest, f"{start}src/lib.rs" in there, f"{start}src/main.rs" in there)
        target = target.replace("-", "_")
        out[f] = Target(name, target, kind, start + at), "::".join([target, *segments])
    return out


def _join(folder: str, rest: str) -> str:
    parts: list[str] = []
    for p in f"{folder}/{rest}".split("/"):
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def modules(found: list[Target], declared: dict[str, list[tuple[list[str], str, str | None]]], files: list[str]) -> dict[str, tuple[Target, str]]:
    """file -> (target, module path) of every file that a target reaches, breadth first; the first target to reach a file keeps it.

    declared: for each file its ``mod name;`` items as (enclosing inline modules, name, #[path]).
    """
    there, at = set(files), {}
    queue = [(t.root, t, t.name, True) for t in found]
    for file, target, path, root in queue:
        if file in at:
            continue
        at[file] = (target, path)
        for inline, name, where in declared.get(file, ()):
            child = child_file(file, root, inline, name, where, there)
            if child and child not in at:
                queue.append((child, target, "::".join([path, *inline, name]), False))
    return at
