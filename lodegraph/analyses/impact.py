"""What a change may affect: expansion of the change, affected symbols with evidence, groups, score, tests to run.

All functions take many changes at once; ``q`` names the change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.graph.frame import Graph, impact_edges
from lodegraph.graph.traverse import bfs, paths
from lodegraph.schemas import CALLABLE, IMPACT_DEPTH, IMPACT_NODES, TYPES, rounded

# fixed values: score factors with weight and saturation, and where the levels begin
FACTORS = (("direct_dependents", 0.20, 10), ("transitive_dependents", 0.25, 100), ("affected_modules", 0.20, 10), ("affected_tests", 0.15, 25), ("fan_in", 0.10, 10), ("dependency_depth", 0.10, 6))
MEDIUM_FROM, HIGH_FROM = 25.0, 60.0
STEP_COLUMNS = ("step", "resolution", "lines")


def expand_change(g: Graph, changed: DataFrame) -> DataFrame:
    """changed: q, nid. A callable stands for itself, a type for itself and its methods, a module for all that is written in it and in its submodules."""
    nodes = g.nodes
    at = changed.join(nodes.select("nid", "repo_id", "id", "kind"), "nid")
    own = at.where(F.col("kind").isin(*CALLABLE, *TYPES)).select("q", "nid")
    methods = at.where(F.col("kind").isin(*TYPES)).select("q", "repo_id", F.col("id").alias("parent")).join(nodes.where("kind = 'method'").select("repo_id", "parent", "nid"), ["repo_id", "parent"]).select("q", "nid")
    level = g.scratch.keep(at.where("kind = 'module'").select("q", "repo_id", "id").distinct())
    modules = level
    children = nodes.where("kind = 'module'").select("repo_id", F.col("parent").alias("id"), F.col("id").alias("child"))
    while not level.isEmpty():
        below = level.join(children, ["repo_id", "id"]).select("q", "repo_id", F.col("child").alias("id")).distinct()
        level = g.scratch.keep(below.join(modules, ["q", "repo_id", "id"], "left_anti"))
        modules = modules.unionByName(level)
    inside = modules.join(nodes.select("repo_id", F.col("module").alias("id"), "nid"), ["repo_id", "id"]).select("q", "nid")
    named = modules.join(nodes.select("repo_id", "id", "nid"), ["repo_id", "id"]).select("q", "nid")
    return own.unionByName(methods).unionByName(inside).unionByName(named).distinct()


def file_change(g: Graph, files: DataFrame) -> DataFrame:
    """files: q, repo_id, file. All symbols written in the file."""
    return files.join(g.nodes.select("repo_id", "file", "nid"), ["repo_id", "file"]).select("q", "nid").distinct()


@dataclass
class Impact:
    """seeds: q, nid. affected: q, nid, depth, confidence, parent, STEP_COLUMNS; certain and possible ones never overlap. truncated: q."""

    graph: Graph
    seeds: DataFrame
    affected: DataFrame
    truncated: DataFrame

    @property
    def certain(self) -> DataFrame:
        return self.affected.where("confidence = 'certain'")

    def evidence(self) -> DataFrame:
        """(q, nid, path): the steps from the affected symbol to the change, nearest first; each a struct of nid, parent and STEP_COLUMNS."""
        scratch = self.graph.scratch
        starts = self.seeds.select("q", "nid", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), *[F.lit(None).cast(t).alias(c) for c, t in dict(self.affected.dtypes).items() if c in STEP_COLUMNS])
        whole = starts.unionByName(self.affected.select(*starts.columns))
        return paths(whole, scratch, list(STEP_COLUMNS))

    def groups(self, by: str) -> DataFrame:
        """(q, name, symbols, tests) of the certain results, by ``file`` or ``module``; null names form no group."""
        of = self.graph.nodes.select("nid", F.col(by).alias("name"), "is_test")
        return self.certain.join(of, "nid").where("name is not null").groupBy("q", "name").agg(F.count("*").alias("symbols"), F.count_if("is_test").alias("tests"))

    def inputs(self) -> DataFrame:
        """(q, and the values of FACTORS); only certain results count."""
        g = self.graph
        of = g.nodes.select("nid", "module", "is_test")
        per = self.certain.join(of, "nid").groupBy("q").agg(
            F.count_if(F.col("depth") == 1).alias("direct_dependents"), F.count("*").alias("transitive_dependents"), F.count_distinct("module").alias("affected_modules"),
            F.count_if("is_test").alias("affected_tests"), F.max("depth").cast("bigint").alias("dependency_depth"),
        )
        calls = g.edges.where("relation = 'CALLS'").select(F.col("dst").alias("nid"), "src")
        callers = self.seeds.join(calls, "nid").select("q", F.col("src").alias("nid")).join(self.seeds, ["q", "nid"], "left_anti").groupBy("q").agg(F.count_distinct("nid").alias("fan_in"))
        every = self.seeds.select("q").distinct().join(per, "q", "left").join(callers, "q", "left")
        return every.select("q", *[F.coalesce(F.col(n), F.lit(0).cast("bigint")).alias(n) for n, _, _ in FACTORS])

    def factors(self) -> DataFrame:
        """(q, factor, value, saturation, weight, normalized, contribution)."""
        rows = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("value"), F.lit(s).alias("saturation"), F.lit(w).alias("weight"), part(F.col(n), s).alias("ratio")) for n, w, s in FACTORS])
        flat = self.inputs().select("q", F.explode(rows).alias("f")).select("q", "f.*")
        return flat.select("q", "factor", "value", "saturation", "weight", rounded(F.col("ratio"), 3).alias("normalized"), rounded(100 * F.col("weight") * F.col("ratio"), 1).alias("contribution"))

    def score(self) -> DataFrame:
        """(q, FACTORS, score, level): contributions are rounded before they are added."""
        inputs = self.inputs()
        total = sum((rounded(100 * w * part(F.col(n), s), 1) for n, w, s in FACTORS), F.lit(0.0))
        return inputs.withColumn("score", rounded(total, 1)).withColumn("level", F.when(F.col("score") < MEDIUM_FROM, "low").when(F.col("score") < HIGH_FROM, "medium").otherwise("high"))


def part(value: Column, saturation: int) -> Column:
    """ln(1 + value) / ln(1 + saturation), at most 1."""
    import math

    return F.least(F.lit(1.0), F.log(1.0 + value) / F.lit(math.log(1.0 + saturation)))


def impact(g: Graph, seeds: DataFrame, max_depth: int = IMPACT_DEPTH, max_nodes: int = IMPACT_NODES, possible: bool = False) -> Impact:
    """seeds: q, nid (already expanded). With ``possible``, what only ambiguous calls reach is added as possible."""
    seeds = g.scratch.keep(seeds.select("q", "nid").distinct())
    starts = seeds.join(g.nodes.select("nid", F.col("repo_id").alias("g")), "nid")
    sure = bfs(impact_edges(g).withColumnRenamed("repo_id", "g"), starts, g.scratch, max_depth, max_nodes, STEP_COLUMNS)
    affected = sure.visited.drop("g").where("depth > 0").withColumn("confidence", F.lit("certain"))
    truncated = sure.truncated
    if possible:
        every = bfs(impact_edges(g, True).withColumnRenamed("repo_id", "g"), starts, g.scratch, max_depth, max_nodes, STEP_COLUMNS)
        more = every.visited.drop("g").where("depth > 0").join(sure.visited.select("q", "nid"), ["q", "nid"], "left_anti").withColumn("confidence", F.lit("possible"))
        affected = affected.unionByName(more)
        truncated = truncated.unionByName(every.truncated).distinct()
    return Impact(g, seeds, g.scratch.keep(affected), truncated)


def select_tests(g: Graph, seeds: DataFrame, max_depth: int = IMPACT_DEPTH, max_nodes: int = IMPACT_NODES, possible: bool = False, per_symbol: bool = True) -> dict[str, DataFrame]:
    """Tests to run for each change: ``selected`` (q, nid, depth, calls, confidence, selection), ``changed_tests`` (q, nid), ``reaches`` (q, seed, nid) and ``untested`` (q, nid).

    A test is direct with at most one call in its chain, else transitive; what
    only ambiguous calls reach is possible. One traversal keyed by (q, seed)
    tells which changed callable each test reaches; without ``per_symbol`` it is
    left out, with ``reaches`` and ``untested``.
    """
    report = impact(g, seeds, max_depth, max_nodes, possible)
    tests = g.nodes.where("is_test").select("nid")
    chains = report.evidence().select("q", "nid", F.size(F.filter("path", lambda s: s["step"].isin("calls", "may_call"))).alias("calls"))
    selected = report.affected.join(tests, "nid", "left_semi").join(chains, ["q", "nid"]).select(
        "q", "nid", "depth", "calls", "confidence", F.when(F.col("confidence") == "possible", "possible").when(F.col("calls") <= 1, "direct").otherwise("transitive").alias("selection")
    )
    out = {"selected": selected, "changed_tests": report.seeds.join(tests, "nid", "left_semi").select("q", "nid"), "truncated": report.truncated}
    if not per_symbol:
        return out
    callables = report.seeds.join(g.nodes.where(F.col("kind").isin(*CALLABLE) & ~F.coalesce("is_test", F.lit(False))).select("nid"), "nid", "left_semi")
    keyed = callables.join(g.nodes.select("nid", F.col("repo_id").alias("g")), "nid").select("g", F.struct(F.col("q").cast("string").alias("of"), F.col("nid").alias("seed")).alias("q"), "nid")
    alone = bfs(impact_edges(g).withColumnRenamed("repo_id", "g"), keyed.withColumn("q", F.to_json("q")), g.scratch, max_depth, max_nodes)
    key = F.from_json("q", "of string, seed bigint")
    reaches = alone.visited.where("depth > 0").join(tests, "nid", "left_semi").select(key.alias("k"), "nid").select(F.col("k.of").alias("q"), "k.seed", "nid")
    untested = callables.join(reaches.select("q", F.col("seed").alias("nid")), ["q", "nid"], "left_anti")
    return out | {"reaches": reaches, "untested": untested.select("q", "nid")}
