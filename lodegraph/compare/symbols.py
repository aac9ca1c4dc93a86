"""Symbols that a revision added, removed, modified or moved, and the lines that hunks touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: changes in report order
CHANGES = ("modified", "added", "removed", "moved")


def compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """base, head: repo_id, id, kind, name, fingerprint, signature. (repo_id, id, previous_id, change, signature_changed).

    A symbol of both sides is modified where its fingerprint differs; modules
    never are. What is left on one side is moved where exactly one removed and
    one added symbol agree in kind, name and a fingerprint that is not null.
    """
    old = base.select("repo_id", "id", F.col("kind").alias("k0"), F.col("name").alias("n0"), F.col("fingerprint").alias("f0"), F.col("signature").alias("s0"), F.lit(True).alias("in_base"))
    both = old.join(head.select("repo_id", "id", "kind", "name", "fingerprint", "signature", F.lit(True).alias("in_head")), ["repo_id", "id"], "full")
    change = (
        F.when(F.col("in_base").isNull(), "added")
        .when(F.col("in_head").isNull(), "removed")
        .when((F.col("kind") != "module") & ~F.col("f0").eqNullSafe(F.col("fingerprint")), "modified")
    )
    flat = both.withColumn("change", change).where("change is not null")
    gone = flat.where("change = 'removed'").select("repo_id", "id", F.col("k0").alias("kind"), F.col("n0").alias("name"), F.col("f0").alias("fingerprint"))
    new = flat.where("change = 'added'").select("repo_id", "id", "kind", "name", "fingerprint")
    moves = moved_pairs(gone, new)
    modified = flat.where("change = 'modified'").select("repo_id", "id", F.lit(None).cast("string").alias("previous_id"), "change", F.coalesce(F.col("s0") != F.col("signature"), F.lit(False)).alias("signature_changed"))
    single = flat.where("change <> 'modified'").select("repo_id", "id", "change")
    taken = moves.select("repo_id", F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit("removed").alias("change")), F.struct(F.col("to_id").alias("id"), F.lit("added").alias("change")))).alias("t")).select("repo_id", "t.*")
    rest = single.join(taken, ["repo_id", "id", "change"], "left_anti").select("repo_id", "id", F.lit(None).cast("string").alias("previous_id"), "change", F.lit(False).alias("signature_changed"))
    return modified.unionByName(rest).unionByName(moves.select("repo_id", F.col("to_id").alias("id"), F.col("from_id").alias("previous_id"), F.lit("moved").alias("change"), F.lit(False).alias("signature_changed")))


def moved_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(repo_id, from_id, to_id) where a key occurs exactly once on either side."""
    key = ["repo_id", "kind", "name", "fingerprint"]
    once = lambda df, name: df.where("fingerprint is not null").groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return once(removed, "from_id").join(once(added, "to_id"), key).select("repo_id", "from_id", "to_id")


def touched(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """symbols: repo_id, id, file, start_line, end_line. hunks: repo_id, file, start, lines. (repo_id, id, first, last): the lines of each symbol that a hunk covers.

    A hunk without lines (a pure deletion) touches a symbol only where it lies
    strictly inside, and then as the single line before it.
    """
    meet = symbols.join(hunks, ["repo_id", "file"]).where(
        ((F.col("lines") == 0) & (F.col("start_line") <= F.col("start")) & (F.col("start") < F.col("end_line")))
        | ((F.col("lines") > 0) & (F.col("start") <= F.col("end_line")) & (F.col("start") + F.col("lines") - 1 >= F.col("start_line")))
    )
    last = F.when(F.col("lines") == 0, F.col("start")).otherwise(F.least(F.col("start") + F.col("lines") - 1, F.col("end_line")))
    return meet.select("repo_id", "id", F.greatest("start", "start_line").alias("first"), last.alias("last"))


def uncovered(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, id) with a touched line that lies in none of its direct children: the change is its own. Others differ only through children."""
    lines = ranges.select("repo_id", "id", F.explode(F.sequence("first", "last")).alias("line")).distinct()
    child = symbols.where("parent is not null").select("repo_id", F.col("parent").alias("id"), "start_line", "end_line")
    covered = lines.join(child, ["repo_id", "id"]).where("line between start_line and end_line").select("repo_id", "id", "line")
    return lines.join(covered, ["repo_id", "id", "line"], "left_anti").select("repo_id", "id").distinct()


def downstream(certain_first: DataFrame) -> DataFrame:
    """The best entry of each (q, id) by confidence, then side: rows carry q, id, confidence, side and what else."""
    from lodegraph.schemas import rank_of

    rest = [c for c in certain_first.columns if c not in ("q", "id")]
    order = F.struct(rank_of(F.col("confidence"), ("certain", "possible")), rank_of(F.col("side"), ("head", "base")))
    return certain_first.groupBy("q", "id").agg(F.min_by(F.struct(*rest), order).alias("b")).select("q", "id", "b.*")


def rename_ends(edges: DataFrame, renames: DataFrame, *columns: str) -> DataFrame:
    """Replaces ids in these columns by what ``renames`` (repo_id, from_id, to_id) says."""
    for c in columns:
        names = renames.select(F.col("repo_id"), F.col("from_id").alias(c), F.col("to_id").alias("_new"))
        edges = edges.join(names, ["repo_id", c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return edges
