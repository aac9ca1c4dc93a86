"""Sessions, and the shared folder in which lineage is cut.

Iterative operators write each round as a Parquet table below the folder that
``spark.checkpoint.dir`` names. All executors share it, so a lost executor
costs a re-read and never a lost block. A folder of our own is used only where
the setting is absent, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lodegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` wins over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


class Scratch:
    """Tables written to the shared folder: ``keep`` cuts lineage, ``drop`` frees a table that no plan reads any more. What is left goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        """Deletes every table of this scratch, if the session still runs."""
        try:
            self._delete(self.root)
        except Exception:
            pass

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            self._delete(path)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size, 0 where it knows none; no job runs."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def buckets_for(df: DataFrame, bytes_each: int = 16 << 20, least: int = 8, most: int = 1_000_000) -> int:
    """How many hash buckets keep each one near ``bytes_each``; as many as shuffle partitions where the size is unknown."""
    known = planned_bytes(df)
    wanted = known // bytes_each + 1 if known else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, wanted))


def coalesce_text(c: Column) -> Column:
    """Hash input in which null differs from every text (hash functions skip nulls)."""
    return F.coalesce(c, F.lit("\u0000null"))
