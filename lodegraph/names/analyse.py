"""Source texts of many repositories to fact tables: files are read where they lie, then each repository's facts are resolved in one group."""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.names.resolve import Repository, Resolution
from lodegraph.operators.tiers import Tiers
from lodegraph.rustlex.items import Facts, read_file
from lodegraph.schemas import CANDIDATES_LISTED
from lodegraph.session import Scratch
from lodegraph.sources.layout import by_path, child_file, dependency_names, modules, targets

FACTS = "repo_id string, tab string, row string"


def lay_out(repo: str, manifests: dict[str, str], declared: dict[str, list], unreached: bool) -> dict[str, tuple[str, str, str]]:
    """path -> (module path, crate, target kind) of the Rust files. declared: what each file's ``mod`` items say.

    unreached: files that no target's ``mod`` items reach get the crate and
    module that their path tells; else they are left out.
    """
    rust = sorted(declared)
    usual, found, there = by_path(repo, manifests, rust), targets(repo, manifests, rust), set(rust)
    roots = {t.root for t in found}
    reached = {c for p in rust for inline, name, where in declared[p] if (c := child_file(p, p in roots, inline, name, where, there))}
    at = modules([t for t in found if t.root not in reached or t.kind in ("lib", "bin")], declared, rust)
    return {p: (path, t.name, t.kind) for p, (t, path) in ((usual if unreached else {}) | at).items()}


def link(facts: dict[str, tuple[Facts, str, str]], dependencies: frozenset[str]) -> Resolution:
    """All names of one repository from the facts of its files: path -> (facts, crate, target kind)."""
    _make_unique(facts)
    _drop_unknown_parents(facts)
    return Repository(facts, dependencies).resolve()


def _is_manifest(path: str) -> bool:
    return path.rpartition("/")[2] == "Cargo.toml"


_MOD_ITEM = re.compile(r"\bmod\s+(?:r#)?\w+\s*;")


def declared_modules(text: str, path: str) -> list:
    """The ``mod name;`` items of a file; texts that cannot have one are not read."""
    return read_file(text, path, "").modules if _MOD_ITEM.search(text) else []


def analyse(files: dict[str, str], repo: str, unreached: bool = False) -> Resolution:
    """All of one repository in memory: path -> text of its Rust files and Cargo.toml manifests."""
    manifests = {p: t for p, t in files.items() if _is_manifest(p)}
    declared = {p: declared_modules(t, p) for p, t in files.items() if p.endswith(".rs")}
    at = lay_out(repo, manifests, declared, unreached)
    return link({p: (read_file(files[p], p, path), crate, kind) for p, (path, crate, kind) in at.items()}, frozenset(n for t in manifests.values() for n in dependency_names(t)))


def _make_unique(facts: dict) -> None:
    """Equal ids of different files get the next free number, in order of paths."""
    taken: set[str] = set()
    for p in sorted(facts):
        renamed = {}
        for s in facts[p][0].symbols:
            if s.id in taken and s.kind != "module":
                n, base = 2, s.id.partition("#")[0]
                while f"{base}#{n}" in taken:
                    n += 1
                renamed[s.id] = f"{base}#{n}"
        f = facts[p][0]
        for s in f.symbols:
            s.id, s.parent = renamed.get(s.id, s.id), renamed.get(s.parent, s.parent)
        for x in (*f.imports, *f.bindings):
            x.scope = renamed.get(x.scope, x.scope)
        for c in f.calls:
            c.caller = renamed.get(c.caller, c.caller)
        for b in f.impls:
            b.methods = [renamed.get(m, m) for m in b.methods]
        taken |= {s.id for s in f.symbols}


def _drop_unknown_parents(facts: dict) -> None:
    """A file's module has no parent where no file or item gives that module."""
    known = {s.id for f, _, _ in facts.values() for s in f.symbols}
    for f, _, _ in facts.values():
        if f.symbols[0].parent not in known:
            f.symbols[0].parent = None


def _rows(repo: str, r: Resolution) -> Iterator[tuple[str, dict]]:
    for s in r.symbols:
        yield "symbols", {"id": s.id, "kind": s.kind, "name": s.name, "qualified_name": s.qualified_name, "start_line": s.start_line, "end_line": s.end_line, "parent": s.parent, "module": s.module, "is_test": s.is_test, "signature": s.signature, "fingerprint": s.fingerprint}
    for e in r.edges:
        yield "edges", {"from_id": e.source, "to_id": e.target, "relation": e.relation, "resolution": e.via, "lines": e.lines}
    for caller, callee, reason, line, candidates in r.ambiguous:
        yield "ambiguous_calls", {"caller": caller, "callee": callee, "line": line, "reason": reason, "candidates": candidates[:CANDIDATES_LISTED], "candidate_count": len(candidates)}
    for caller, callee, reason, line in r.unresolved:
        yield "unresolved_calls", {"caller": caller, "callee": callee, "line": line, "reason": reason}


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the layout of a repository needs of each file: manifests whole, of Rust files the ``mod`` items."""
    for b in batches:
        said = [t if _is_manifest(p) else json.dumps(declared_modules(t, p)) for p, t in zip(b["path"], b["text"])]
        yield pd.DataFrame({"repo_id": b["repo_id"], "path": b["path"], "said": said})


def _layout(b: pd.DataFrame) -> pd.DataFrame:
    repo, said = b["repo_id"].iloc[0], dict(zip(b["path"], b["said"]))
    manifests = {p: t for p, t in said.items() if _is_manifest(p)}
    at = lay_out(repo, manifests, {p: json.loads(t) for p, t in said.items() if not _is_manifest(p)}, True)
    needs = sorted({n for t in manifests.values() for n in dependency_names(t)})
    rows = [(repo, p, path, crate, kind, needs) for p, (path, crate, kind) in sorted(at.items())]
    return pd.DataFrame(rows, columns=["repo_id", "path", "module", "crate", "target", "needs"])


_PLACED = "repo_id string, path string, module string, crate string, target string, needs array<string>"
_FACTS = "repo_id string, path string, module string, hash bigint, facts binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        facts = [pickle.dumps(read_file(t, p, m)) for t, p, m in zip(b["text"], b["path"], b["module"])]
        yield b[["repo_id", "path", "module", "hash"]].assign(facts=facts)


def fact_cache(spark: SparkSession, folder: str) -> Tiers:
    """Facts of files as they were last read."""
    return Tiers(spark, folder, {"facts": (_FACTS, ["repo_id", "path"])})


def read_facts(texts: DataFrame, cache: Tiers | None = None) -> DataFrame:
    """texts: repo_id, path, module, text. (repo_id, path, module, hash, facts).

    With a cache, only files whose text or module changed since they were last
    read are read again, and only these are written.
    """
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    if cache is None:
        return hashed.mapInPandas(_read, _FACTS)
    same = ["repo_id", "path", "module", "hash"]
    marker = cache.marker()
    new = hashed.join(cache.read("facts", marker).select(same), same, "left_anti")
    return cache.read("facts", cache.commit(marker, {"facts": new.mapInPandas(_read, _FACTS)}, {})).join(hashed.select(same), same, "left_semi")


def _link(b: pd.DataFrame) -> pd.DataFrame:
    repo = b["repo_id"].iloc[0]
    facts = {p: (pickle.loads(f), crate, target) for p, f, crate, target in zip(b["path"], b["facts"], b["crate"], b["target"])}
    r = link(facts, frozenset(b["needs"].iloc[0]))
    return pd.DataFrame([(repo, tab, json.dumps(row)) for tab, row in _rows(repo, r)], columns=["repo_id", "tab", "row"])


SCHEMAS = {
    "symbols": "id string, kind string, name string, qualified_name string, start_line int, end_line int, parent string, module string, is_test boolean, signature string, fingerprint string",
    "edges": "from_id string, to_id string, relation string, resolution string, lines array<int>",
    "ambiguous_calls": "caller string, callee string, line int, reason string, candidates array<string>, candidate_count int",
    "unresolved_calls": "caller string, callee string, line int, reason string",
}


def fact_tables(files: DataFrame, cache: Tiers | None = None) -> dict[str, DataFrame]:
    """files: repo_id, path, text of Rust files and manifests. The fact tables by name, each with repo_id.

    Texts are read where they lie, whatever repository they belong to: once for
    their ``mod`` items, which lay the repository out, and once for their facts.
    Only facts meet in the group of a repository, as name resolution needs. With
    a ``fact_cache``, unchanged files are not read for their facts again.
    Texts without a repository or path, and null ones, are left out; of several
    for one path the largest counts. Every other Rust text gives at least its module.
    """
    texts = files.select("repo_id", "path", "text").where("repo_id is not null and path is not null and text is not null and (path like '%.rs' or path = 'Cargo.toml' or path like '%/Cargo.toml')")
    texts = texts.groupBy("repo_id", "path").agg(F.max("text").alias("text"))
    layout = texts.mapInPandas(_outlines, "repo_id string, path string, said string").groupBy("repo_id").applyInPandas(_layout, _PLACED)
    layout = Scratch(files.sparkSession, "layout").keep(layout)
    facts = read_facts(texts.join(layout.select("repo_id", "path", "module"), ["repo_id", "path"]), cache)
    placed = facts.select("repo_id", "path", "facts").join(layout.drop("module"), ["repo_id", "path"])
    rows = placed.groupBy("repo_id").applyInPandas(_link, FACTS)
    return {name: rows.where(F.col("tab") == name).select("repo_id", F.from_json("row", schema).alias("r")).select("repo_id", "r.*") for name, schema in SCHEMAS.items()}
