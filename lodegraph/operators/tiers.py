"""Keyed tables that grow by batches, in the shared folder.

A batch is appended as a tier of its own; neighbouring tiers of similar size are
merged, so a row is rewritten as often as the logarithm of the number of rows
and a batch costs its own size. What counts is told by a marker, which is
written aside and renamed: a run that dies before leaves nothing that counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another run has committed this sequence number."""


class Tiers:
    """tables: name -> (schema, key columns). Of several rows for one key that of the latest batch counts.

    ``bucket`` names an integer column that follows from the key and by whose
    values the tables are partitioned, so that ``read`` can open some of them.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, list[str]]], bucket: str | None = None):
        self.spark, self.folder, self.tables, self.bucket = spark, folder.rstrip("/"), tables, bucket
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> list[str]:
        p = self._path(f"{self.folder}/done")
        if not self._fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(p)) if n.isdigit())

    def marker(self) -> dict:
        """What the last committed batch left; sequence number -1 before the first."""
        names = self._markers()
        if not names:
            return {"seq": -1, "tables": {}, "extra": {}, "garbage": []}
        stream = self._fs.open(self._path(f"{self.folder}/done/{names[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _rows(self, name: str, paths: list[str], only: list[int] | None = None) -> DataFrame:
        schema, keys = self.tables[name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.schema(f"{schema}, _seq bigint").parquet(paths[0])
        for path in paths[1:]:
            held = held.unionByName(self.spark.read.schema(f"{schema}, _seq bigint").parquet(path))
        if only is not None:
            held = held.where(F.col(self.bucket).isin(only)) if only else held.limit(0)
        if len(paths) == 1:
            return held.drop("_seq")
        rest = [c for c in held.columns if c not in keys and c != "_seq"]
        last = held.groupBy(*keys).agg(F.max(F.struct("_seq", *rest)).alias("r") if rest else F.max("_seq").alias("r"))
        return last.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in held.columns if c != "_seq"])

    def read(self, name: str, marker: dict, only: list[int] | None = None) -> DataFrame:
        """A table as a marker has it, of some buckets if told."""
        return self._rows(name, [t["path"] for t in marker["tables"].get(name, [])], only)

    def write(self, name: str, rows: DataFrame, seq: int) -> dict:
        """A tier that does not count yet."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        marked = rows.withColumn("_seq", F.lit(seq).cast("bigint"))
        (marked.repartition(self.bucket).write.partitionBy(self.bucket) if self.bucket else marked.write).parquet(path)
        return {"path": path, "rows": self.spark.read.schema(marked.schema).parquet(path).count(), "seq": seq}

    def commit(self, marker: dict, batch: dict[str, DataFrame], extra: dict) -> dict:
        """Appends one batch to the state of ``marker``; each key at most once in a batch."""
        seq = marker["seq"] + 1
        tables, garbage = {n: list(t) for n, t in marker["tables"].items()}, []
        for name, rows in batch.items():
            tiers = tables.setdefault(name, [])
            new = self.write(name, rows, seq)
            if new["rows"]:
                tiers.append(new)
            while len(tiers) > 1 and 2 * tiers[-1]["rows"] >= tiers[-2]["rows"]:
                b, a = tiers.pop(), tiers.pop()
                tiers.append(self.write(name, self._rows(name, [a["path"], b["path"]]), b["seq"]))
                garbage += [a["path"], b["path"]]
        done = {"seq": seq, "tables": tables, "extra": extra, "garbage": garbage}
        self._publish(seq, json.dumps(done))
        for path in marker["garbage"]:
            self._fs.delete(self._path(path), True)
        return done

    def remove(self) -> None:
        """Deletes all of it."""
        self._fs.delete(self._path(self.folder), True)

    def _publish(self, seq: int, text: str) -> None:
        target, aside = (self._path(f"{self.folder}/done/{n}") for n in (f"{seq:09d}", f"_{uuid.uuid4().hex}"))
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        try:
            if self._fs.exists(target):
                raise Conflict(f"{target} is there")
            if not self._fs.rename(aside, target):
                raise Conflict(f"{target} cannot be written")
        finally:
            self._fs.delete(aside, False)
