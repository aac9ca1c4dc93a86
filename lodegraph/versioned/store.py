"""A graph stored in tiers of keyed tables: full and incremental writes, tokens, deletion.

The state that an incremental run builds on is valid only while its token is
that of the stored graph.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.tiers import Tiers
from lodegraph.schemas import GRAPH_FORMAT, NotFound, OutdatedIndex


def delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows; null equals only null."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(F.lit(1), *rest).alias("a"))
    b = new.select(*key, F.struct(F.lit(1), *rest).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(*key, change.alias("change")).where("change is not null")


@dataclass
class Written:
    mode: str
    reason: str | None
    token: str
    added: int
    removed: int
    changed: int


class GraphStore:
    """tables: name -> key columns. One folder holds one repository's graph.

    An incremental write appends the rows that differ, and a mark for each that
    is gone; an unchanged table costs a comparison and writes nothing. Readers
    see the version before or after a write, never one in between.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, list[str]]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), tables

    def _tiers(self, schemas: dict[str, str] | None = None) -> Tiers:
        known = schemas or Tiers(self.spark, self.folder, {}).marker()["extra"].get("schemas", {})
        return Tiers(self.spark, self.folder, {n: (f"{known[n]}, _gone boolean", self.keys[n]) for n in known})

    def current(self) -> dict | None:
        """token and format of what is stored."""
        return self._tiers().marker()["extra"] or None

    def load(self, name: str) -> DataFrame:
        tiers = self._tiers()
        marker = tiers.marker()
        state = marker["extra"]
        if not state:
            raise NotFound(self.folder)
        if state["format"] != GRAPH_FORMAT:
            raise OutdatedIndex(f"graph format {state['format']}, not {GRAPH_FORMAT}; index the repository again")
        return tiers.read(name, marker).where(~F.col("_gone")).drop("_gone")

    def why_full(self, token: str | None, force: bool) -> str | None:
        """Why a write has to be a full one, or None."""
        state = self.current()
        if force:
            return "forced"
        if state is None:
            return "not stored yet"
        if state["format"] != GRAPH_FORMAT:
            return "format changed"
        return None if token is not None and token == state["token"] else "no state for the stored graph"

    def _difference(self, name: str, new: DataFrame, counts: dict[str, int]) -> DataFrame:
        old, key = self.load(name), self.keys[name]
        found = delta(old, new, key).persist()
        for r in found.groupBy("change").count().collect():
            counts[r["change"]] += r["count"]
        come = new.join(found.where("change <> 'removed'").select(key), key, "left_semi").withColumn("_gone", F.lit(False))
        gone = old.join(found.where("change = 'removed'").select(key), key, "left_semi").withColumn("_gone", F.lit(True))
        return come.unionByName(gone)

    def write(self, new: dict[str, DataFrame], token: str | None = None, force: bool = False) -> Written:
        """Writes a version: only the differences to the current one where ``token`` is its token, else everything."""
        reason, counts = self.why_full(token, force), {"added": 0, "removed": 0, "changed": 0}
        schemas = {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new[n].schema) for n in self.keys}
        tiers = self._tiers(schemas)
        marker = tiers.marker()
        if reason:
            old = [t["path"] for ts in marker["tables"].values() for t in ts]
            marker = marker | {"tables": {}, "garbage": marker["garbage"] + old}
            batch = {n: new[n].withColumn("_gone", F.lit(False)) for n in self.keys}
        else:
            batch = {n: self._difference(n, new[n], counts) for n in self.keys}
        fresh = uuid.uuid4().hex
        done = tiers.commit(marker, batch, {"token": fresh, "format": GRAPH_FORMAT, "schemas": schemas})
        if reason:
            counts["added"] = sum(t["rows"] for ts in done["tables"].values() for t in ts)
        return Written("full" if reason else "incremental", reason, fresh, **counts)

    def delete(self) -> int:
        """Deletes the graph; gives the number of rows it held."""
        if self.current() is None:
            return 0
        n = sum(self.load(name).count() for name in self.keys)
        Tiers(self.spark, self.folder, {}).remove()
        return n

    def dump(self) -> DataFrame:
        """(tab, row): every row as text, in order, to hold one store against another."""
        parts = [df.select(F.lit(name).alias("tab"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row")) for name in sorted(self.keys) for df in [self.load(name)]]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.orderBy("tab", "row")
