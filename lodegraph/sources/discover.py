"""Source files of repositories as a table: a distributed scan with the filters of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.tables import plain_path

# fixed values: directories that are never scanned, and the largest file that is analysed
PRUNED = (".git", "target", "build", "dist", "vendor", "node_modules", ".svelte-kit", "__pycache__")
TOO_LARGE = 2 * 1024 * 1024


def _glob() -> str:
    """File names of every language, in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in sorted(text.LANGUAGES)) + "}"


def scan(spark: SparkSession, root: str, repo_id: str, rev: str = "worktree") -> DataFrame:
    """(repo_id, rev, path, language, bytes, skipped, text) of every file below root that has a language.

    text is null where the file was not analysed, and skipped says why:
    too_large, not_utf8 or generated. Only files with a language's extension are
    listed; large ones are told by their listing and never opened, the contents
    of others are read by the executors. Pruned folders and hidden ones are left
    out after listing.
    """
    root = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob()).load(root)
    relative = plain_path(F.regexp_replace("path", r"^[a-z]+:/*", "/"))
    base = plain_path(F.lit("/" + root.removeprefix("file:").lstrip("/")))
    path = F.substring(relative, F.length(base) + 2, F.lit(1 << 20))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))

    def placed(rows: DataFrame, body) -> DataFrame:
        named = rows.select(path.alias("path"), F.col("length").alias("bytes"), body.alias("body"))
        kept = named.where(~F.exists(folders, lambda s: s.isin(*PRUNED) | s.startswith(".")))
        return kept.withColumn("language", text.language_of(F.col("path"))).where("language is not null")

    large = placed(listed.where(F.col("length") > TOO_LARGE), F.lit(None).cast("string")).withColumn("skipped", F.lit("too_large"))
    small = placed(listed.where(F.col("length") <= TOO_LARGE), F.try_validate_utf8(F.col("content").cast("string")))
    generated = text.is_generated_name(F.col("path")) | F.coalesce(text.has_generated_header(F.col("body")), F.lit(False))
    small = small.withColumn("skipped", F.when(F.col("body").isNull(), "not_utf8").when(generated, "generated"))
    return small.unionByName(large).select(F.lit(repo_id).alias("repo_id"), F.lit(rev).alias("rev"), "path", "language", "bytes", "skipped", F.when(F.col("skipped").isNull(), F.col("body")).alias("text"))


def file_facts(scanned: DataFrame) -> DataFrame:
    """(repo_id, rev, path, language, bytes, loc, content_hash) of the files that are analysed."""
    kept = scanned.where("skipped is null")
    return kept.select("repo_id", "rev", "path", "language", "bytes", text.nonblank_lines(F.col("text")).alias("loc"), text.content_hash("text").alias("content_hash"))


def skip_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("repo_id", "rev").agg(*[F.count_if(F.col("skipped") == s).alias(s) for s in ("generated", "too_large", "not_utf8")])


def language_totals(files: DataFrame) -> DataFrame:
    """(repo_id, rev, language, files, loc), most lines first within a repository."""
    return files.groupBy("repo_id", "rev", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def snippet(text_row: str, first: int, last: int, most: int = 400) -> list[tuple[int, str]]:
    """Lines first to last of a text, at most ``most``, counted from 1."""
    lines = text_row.split("\n")
    return [(i + 1, lines[i].removesuffix("\r")) for i in range(max(0, first - 1), min(last, len(lines), first - 1 + most))]
