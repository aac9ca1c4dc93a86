"""What two revisions of a graph differ in, and what the differences may affect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.analyses.impact import impact
from lodegraph.compare.symbols import CHANGES, compare, downstream
from lodegraph.graph.frame import Graph
from lodegraph.schemas import CALLABLE, IMPACT_DEPTH, TYPES, rank_of


@dataclass
class Revisions:
    """base and head: graphs; base_marks and head_marks: (repo_id, id, fingerprint, signature) of their own symbols."""

    base: Graph
    head: Graph
    base_marks: DataFrame
    head_marks: DataFrame

    def _symbols(self, g: Graph, marks: DataFrame) -> DataFrame:
        return g.nodes.join(marks, ["repo_id", "id"]).select("repo_id", "id", "kind", "name", "fingerprint", "signature")

    def changes(self) -> DataFrame:
        """(repo_id, place, id, previous_id, change, signature_changed, kind, file, line), in report order: by change, file, line and id."""
        found = compare(self._symbols(self.base, self.base_marks), self._symbols(self.head, self.head_marks))
        where = lambda g, own: g.nodes.select("repo_id", "id", F.struct("kind", "file", F.col("start_line").alias("line")).alias(own))
        at = found.join(where(self.head, "h"), ["repo_id", "id"], "left").join(where(self.base, "b"), ["repo_id", "id"], "left")
        told = at.select("repo_id", "id", "previous_id", "change", "signature_changed", F.when(F.col("change") == "removed", F.col("b")).otherwise(F.col("h")).alias("s"))
        order = Window.partitionBy("repo_id").orderBy(rank_of(F.col("change"), CHANGES), "s.file", "s.line", "id")
        return told.select("repo_id", F.row_number().over(order).alias("place"), "id", "previous_id", "change", "signature_changed", "s.*")

    def affected(self, changes: DataFrame, max_depth: int = IMPACT_DEPTH) -> DataFrame:
        """(repo_id, id, confidence, side, depth): what is downstream of the changes.

        Modified symbols are followed in the head, removed ones (but for
        modules, whose items are removed themselves) in the base. Changed
        symbols under their new and former ids are no results, nor is what the
        head does not hold. Of several ways to a symbol the surest counts, on
        the head's side if both are as sure.
        """
        parts = []
        for g, side, kind in ((self.head, "head", F.col("change") == "modified"), (self.base, "base", (F.col("change") == "removed") & (F.col("kind") != "module"))):
            seeds = changes.where(kind).join(g.nodes.select("repo_id", "id", "nid"), ["repo_id", "id"]).select(F.col("repo_id").alias("q"), "nid")
            rows = impact(g, seeds, max_depth, None, possible=True).affected
            parts.append(g.named(rows, nid="id").select("q", "id", "confidence", F.lit(side).alias("side"), "depth"))
        both = [c.name for c in parts[0].schema]
        best = downstream(parts[0].unionByName(parts[1]).groupBy(*[c for c in both if c != "depth"]).agg(F.min("depth").alias("depth")))
        changed = changes.select(F.col("repo_id").alias("q"), F.explode(F.array_compact(F.array("id", "previous_id"))).alias("id")).distinct()
        there = self.head.nodes.select(F.col("repo_id").alias("q"), "id")
        return best.join(changed, ["q", "id"], "left_anti").join(there, ["q", "id"], "left_semi").select(F.col("q").alias("repo_id"), "id", "confidence", "side", "depth")

    def summary(self, changes: DataFrame, affected: DataFrame) -> DataFrame:
        """One row of counts for each repository with changes."""
        is_kind = lambda kinds: F.col("kind").isin(*kinds)
        own = changes.groupBy("repo_id").agg(
            F.count("*").alias("changes"), *[F.count_if(F.col("change") == c).alias(c) for c in CHANGES], F.count_if("signature_changed").alias("signatures"),
            F.count_if(is_kind(CALLABLE)).alias("callables"), F.count_if(is_kind(TYPES)).alias("types"), F.count_if(F.col("kind") == "module").alias("modules"), F.count_distinct("file").alias("files"),
        )
        of = self.head.nodes.select("repo_id", "id", "is_test", F.col("file").alias("at_file"), F.col("module").alias("at_module"))
        down = affected.join(of, ["repo_id", "id"]).groupBy("repo_id").agg(
            F.count_if(F.col("confidence") == "certain").alias("affected"), F.count_if(F.col("confidence") == "possible").alias("possibly_affected"), F.count_if("is_test").alias("affected_tests"),
            F.count_distinct(F.when(F.col("confidence") == "certain", F.col("at_file"))).alias("affected_files"), F.count_distinct(F.when(F.col("confidence") == "certain", F.col("at_module"))).alias("affected_modules"),
        )
        return own.join(down, "repo_id", "left").na.fill(0)
