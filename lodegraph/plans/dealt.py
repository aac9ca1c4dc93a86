"""Queries p2, p4, p5, p6 and p7, and their SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.operators import balance, orphans, snapshots
from lodegraph.operators.feed import pending_runs
from lodegraph.operators.hierarchy import Hierarchy
from lodegraph.operators.snapshots import Keyed, snapshot_id
from lodegraph.session import coalesce_text
from lodegraph.tables import hash_number, plain_path, table


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each (repo_id, rev); of rows that differ, which none should, the largest counts."""
    rest = ["seq", "status", "index_token", "state_token", "store_token"]
    one = table(spark, folder, "index_runs").groupBy("repo_id", "rev").agg(F.max(F.struct(*rest)).alias("r"))
    return one.select("repo_id", "rev", *[f"r.{c}" for c in rest])


def _snap():
    return snapshot_id(F.col("repo_id"), F.col("rev"))


def file_rows(spark: SparkSession, folder: str) -> Keyed:
    rows = table(spark, folder, "files").select("repo_id", "rev", plain_path(F.col("path")).alias("path"), "content_hash", "observed_at").where("path is not null")
    return Keyed(rows, [F.col("repo_id"), F.col("rev")], [F.col("repo_id"), F.col("path")], hash_number(F.col("content_hash")), F.unix_micros("observed_at"))


def dependency_rows(spark: SparkSession, folder: str) -> Keyed:
    rows = table(spark, folder, "depends_on").select("repo_id", "rev", "level", "from_id", "to_id", "weight", "via", "recorded_at")
    via = F.concat_ws("\u0001", F.array_sort(F.array_distinct(F.transform("via", coalesce_text))))
    value = F.xxhash64(coalesce_text(F.col("weight").cast("string")), F.coalesce(via, F.lit("\u0000null")))
    return Keyed(rows, [F.col("repo_id"), F.col("rev")], [F.col(c) for c in ("repo_id", "level", "from_id", "to_id")], (F.lit(1).cast("tinyint"), value), F.unix_micros("recorded_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    full = runs(spark, folder).where("status is null or status <> 'aborted'")
    plan = snapshots.consecutive(full, "repo_id", ["seq", "rev"], _snap())
    revs = full.select(_snap().alias("later"), "repo_id", "rev")
    item = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("level", "from_id", "to_id")])
    parts = []
    for tab, rows, name in (("files", file_rows(spark, folder), F.col("path")), ("depends_on", dependency_rows(spark, folder), item)):
        parts.append(snapshots.snapshot_changes(rows, plan, {"item": name}).withColumn("tab", F.lit(tab)))
    names = F.array(*map(F.lit, snapshots.CHANGE_NAMES))
    changed = parts[0].unionByName(parts[1]).join(revs, "later")
    return changed.select("tab", "repo_id", "rev", "item", F.element_at(names, F.col("change").cast("int") + 1).alias("change"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p2_found(spark, folder).groupBy("tab", "repo_id", "rev").agg(*[F.count_if(F.col("change") == c).alias(c) for c in snapshots.CHANGE_NAMES])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    done = runs(spark, folder).where("status = 'succeeded'").withColumn("snap", _snap())
    states = done.where("index_token is not null").groupBy("repo_id", F.col("index_token").alias("state_token")).agg(F.max(F.struct("seq", "rev", "snap")).alias("b"))
    based = done.join(states, ["repo_id", "state_token"], "left").withColumn("b", F.when(F.col("state_token") == F.col("store_token"), F.col("b")))
    started = based.select("snap", F.col("b.snap").alias("base"), F.col("seq").alias("txn"), F.col("b.seq").alias("base_txn"))
    t = file_rows(spark, folder)
    kind, number = t.row_hash
    rows = t.rows.select(_snap().alias("snap"), "path", F.struct(kind.alias("kind"), number.alias("number")).alias("version"), t.order.alias("at"))
    found = pending_runs(rows, started, "snap", "path", "version", F.col("at"))
    return found.join(done.select("snap", "repo_id", "rev"), "snap").select("repo_id", "rev", "path")


def p4_per_run(spark: SparkSession, folder: str) -> DataFrame:
    """How many files each succeeded run has to process."""
    done = runs(spark, folder).where("status = 'succeeded'").select("repo_id", "rev", "seq")
    per = p4_found(spark, folder).groupBy("repo_id", "rev").agg(F.count("*").alias("n_files"))
    return done.join(per, ["repo_id", "rev"], "left").select("repo_id", "rev", "seq", F.coalesce("n_files", F.lit(0).cast("bigint")).alias("n_files"))


def symbol_tree(spark: SparkSession, folder: str, name: str | None = None) -> Hierarchy:
    rows = table(spark, folder, "symbols").select("repo_id", "id", "name", "parent", "module", "extracted_at")
    parent = F.coalesce("parent", F.when(F.col("module") != F.col("id"), F.col("module")))
    return Hierarchy(rows, "repo_id", "id", parent, "extracted_at", name)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return symbol_tree(spark, folder).endless().select(F.col("grp").alias("repo_id"), "id")


def p5_tree(spark: SparkSession, folder: str) -> DataFrame:
    t = symbol_tree(spark, folder, "name").tree()
    return t.select(F.col("grp").alias("repo_id"), "id", "path", "depth", "root_id", "n_descendants")


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of each symbol that is nobody's child (a root), through the tour's intervals."""
    h = symbol_tree(spark, folder)
    roots = h.nodes.join(h.tours.where("depth = 0 and not endless"), "v").select("grp", "id")
    return h.descendants(roots).select(F.col("grp").alias("repo_id"), "id", "descendant")


def p5_all_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of each symbol, roots or not."""
    return symbol_tree(spark, folder).all_descendants().select(F.col("grp").alias("repo_id"), "id", "descendant")


def reference_sources(spark: SparkSession, folder: str) -> list[DataFrame]:
    edges = table(spark, folder, "edges").select("repo_id", F.explode(F.array("from_id", "to_id")).alias("ref"), "recorded_at")
    depends = table(spark, folder, "depends_on").select("repo_id", F.explode(F.array_distinct(F.transform("evidence", lambda e: e["to_id"]))).alias("ref"), "recorded_at")
    calls = table(spark, folder, "ambiguous_calls").select("repo_id", F.explode(F.array_distinct("candidates")).alias("ref"), "recorded_at")
    return [orphans.reference_events(df, tab, "repo_id", F.col("ref"), "recorded_at") for tab, df in (("edges", edges), ("depends_on", depends), ("ambiguous_calls", calls))]


def _orphans(spark: SparkSession, folder: str, history: bool = False) -> DataFrame:
    symbols, edges, depends = (table(spark, folder, t) for t in ("symbols", "edges", "depends_on"))
    parents = orphans.parent_events(symbols, "repo_id", "id", "extracted_at", "deleted_at", steps=True)
    shared = orphans.parent_events(table(spark, folder, "shared_symbols"), None, "id", "extracted_at", "deleted_at")
    return orphans.replay(reference_sources(spark, folder), parents, shared, [symbols, edges, depends], history)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """What is pending after all months have arrived, one batch each."""
    return _orphans(spark, folder).select("tab", "period", F.col("scope").alias("repo_id"), F.col("key").alias("ref_id"), "state")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p6_found(spark, folder).groupBy("tab", "period", "state").agg(F.count("*").alias("orphans"))


def p6_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """What was pending as known at the end of each month in which that changed: rows and symbols that came later do not count yet."""
    changes = _orphans(spark, folder, history=True).where("n <> 0")
    so_far = Window.partitionBy("tab", "period", "state").orderBy("step")
    told = changes.select("tab", "period", "state", "step", F.sum("n").over(so_far).alias("orphans"))
    as_of = F.format_string("%04d-%02d", F.floor((F.col("step") - 1) / 12), F.pmod(F.col("step") - 1, F.lit(12)) + 1)
    return told.select(as_of.alias("as_of"), "tab", "period", "state", "orphans")


#: A key is hot from this share of all rows (edges) or of the summed weight (depends_on).
HOT_SHARE = 0.02


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    edges, depends = table(spark, folder, "edges"), table(spark, folder, "depends_on")
    n = edges.count()
    weight = depends.agg(F.sum("weight")).first()[0] or 0
    by_rows = balance.hot_keys(balance.per_key(edges, "to_id", "from_id"), "n_rows", n, HOT_SHARE)
    by_weight = balance.hot_keys(balance.per_key(depends, "to_id", "from_id", "weight"), "weight", weight, HOT_SHARE)
    return by_rows.select(F.lit("edges").alias("tab"), F.col("key").alias("to_id")).unionByName(by_weight.select(F.lit("depends_on").alias("tab"), F.col("key").alias("to_id")))


def p7_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Per to_id: rows and callers in edges, summed weight in depends_on; null where the table lacks the key."""
    e = balance.per_key(table(spark, folder, "edges"), "to_id", "from_id").select(F.col("key").alias("to_id"), "n_rows", F.col("n_members").alias("n_callers"))
    d = balance.per_key(table(spark, folder, "depends_on"), "to_id", "from_id", "weight").select(F.col("key").alias("to_id"), F.col("weight").cast("bigint").alias("weight"))
    return e.join(d, "to_id", "full").select("to_id", "n_rows", "n_callers", "weight")


def p7_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Callers of every shared symbol by its kind: edges joined with their targets by the balanced join."""
    edges = table(spark, folder, "edges").select("repo_id", "from_id", "to_id")
    shared = table(spark, folder, "shared_symbols").groupBy(F.col("id").alias("to_id")).agg(F.max_by("kind", "extracted_at").alias("kind"))
    return balance.balanced_join(edges, shared, "to_id").groupBy("kind").agg(F.count("*").alias("n_rows"), F.count("to_id").alias("n_targets"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p4_found, p4_per_run, p5_found, p5_tree, p5_descendants, p5_all_descendants, p6_found, p6_counts, p6_monthly, p7_found, p7_keys, p7_joined)}

_PATHS = r"""regexp_replace(regexp_replace(replace(path, '\', '/'), '(^|/)(\.?/)+', '\1', 'g'), '(/\.?)+$', '')"""
_FILES = f"""
files_x AS (
  SELECT repo_id, rev, path, h FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, rev, path ORDER BY observed_at DESC NULLS LAST, h DESC NULLS LAST) AS rn
    FROM (SELECT repo_id, rev, {_PATHS} AS path, observed_at,
                 lpad(regexp_replace(regexp_replace(lower(trim(content_hash, E' \\t\\n\\r')), '^0x', ''), '^0+', ''), 16, '0') AS h FROM files WHERE path IS NOT NULL)
  ) WHERE rn = 1),
runs_x AS (SELECT DISTINCT repo_id, rev, seq, status, index_token, state_token, store_token FROM index_runs)"""
_P2 = f"""WITH {_FILES},
full_x AS (SELECT repo_id, rev, lag(rev) OVER w AS prev FROM runs_x WHERE status IS DISTINCT FROM 'aborted' WINDOW w AS (PARTITION BY repo_id ORDER BY seq)),
pairs AS (SELECT * FROM full_x WHERE prev IS NOT NULL),
rows_x AS (
  SELECT 'files' AS tab, repo_id, rev, path AS item, coalesce(h, 'null') AS val FROM files_x
  UNION ALL
  SELECT DISTINCT 'depends_on', repo_id, rev, level || '|' || from_id || '|' || to_id, weight || ':' || list_sort(list_distinct(via))::VARCHAR FROM depends_on),
now_x AS (SELECT r.*, p.prev FROM rows_x r JOIN pairs p USING (repo_id, rev)),
old_x AS (SELECT r.tab, p.repo_id, p.rev, r.item, r.val FROM rows_x r JOIN pairs p ON r.repo_id = p.repo_id AND r.rev = p.prev)
SELECT coalesce(n.tab, o.tab) AS tab, coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.rev, o.rev) AS rev, coalesce(n.item, o.item) AS item,
       CASE WHEN o.item IS NULL THEN 'added' WHEN n.item IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now_x n FULL JOIN old_x o ON n.tab = o.tab AND n.repo_id = o.repo_id AND n.rev = o.rev AND n.item = o.item
WHERE n.val IS DISTINCT FROM o.val"""
_P4 = f"""WITH {_FILES},
done AS (SELECT * FROM runs_x WHERE status = 'succeeded'),
based AS (SELECT d.repo_id, d.rev, d.seq, b.rev AS base FROM done d LEFT JOIN done b ON b.repo_id = d.repo_id AND b.index_token = d.state_token AND b.index_token = d.store_token),
found AS (SELECT f.repo_id, f.rev, f.path FROM files_x f JOIN based b USING (repo_id, rev)
  LEFT JOIN files_x o ON o.repo_id = f.repo_id AND o.rev = b.base AND o.path = f.path
  WHERE o.path IS NULL OR o.h IS DISTINCT FROM f.h)"""
_TREE = """WITH RECURSIVE sym AS (
  SELECT repo_id, id, name, p FROM (SELECT repo_id, id, name, coalesce(parent, CASE WHEN module <> id THEN module END) AS p,
    row_number() OVER (PARTITION BY repo_id, id ORDER BY extracted_at DESC, coalesce(parent, module) DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1),
linked AS (SELECT s.repo_id, s.id, s.name, o.id AS p FROM sym s LEFT JOIN sym o ON o.repo_id = s.repo_id AND o.id = s.p),
tree AS (
  SELECT repo_id, id, coalesce(name, id) AS path, 0 AS depth, id AS root_id FROM linked WHERE p IS NULL
  UNION ALL
  SELECT l.repo_id, l.id, t.path || '::' || coalesce(l.name, l.id), t.depth + 1, t.root_id FROM linked l JOIN tree t ON l.repo_id = t.repo_id AND l.p = t.id)"""
_REFS = """refs AS (
  SELECT 'edges' AS tab, repo_id, unnest([from_id, to_id]) AS ref_id, recorded_at FROM edges
  UNION ALL SELECT 'depends_on', repo_id, unnest(list_transform(evidence, lambda e: e.to_id)), recorded_at FROM depends_on
  UNION ALL SELECT 'ambiguous_calls', repo_id, unnest(candidates), recorded_at FROM ambiguous_calls),
r AS (SELECT DISTINCT * FROM refs WHERE ref_id IS NOT NULL),
par AS (
  SELECT repo_id, id, min(extracted_at) AS first_at, arg_max(coalesce(deleted_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), extracted_at) AS gone FROM symbols GROUP BY ALL
  UNION ALL
  SELECT NULL, id, min(extracted_at), arg_max(coalesce(deleted_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), extracted_at) FROM shared_symbols GROUP BY id),
found AS (SELECT DISTINCT r.tab, strftime(r.recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS period, r.repo_id, r.ref_id,
  CASE WHEN coalesce(p.id, s.id) IS NULL THEN 'missing' WHEN coalesce(p.first_at, s.first_at) > r.recorded_at THEN 'late' WHEN coalesce(p.gone, s.gone) <= r.recorded_at THEN 'deleted' END AS state
  FROM r LEFT JOIN par p ON p.id = r.ref_id AND p.repo_id = r.repo_id LEFT JOIN par s ON s.id = r.ref_id AND s.repo_id IS NULL)"""
_MONTHLY = """WITH refs AS (
  SELECT 'edges' AS tab, repo_id, unnest([from_id, to_id]) AS ref_id, recorded_at FROM edges
  UNION ALL SELECT 'depends_on', repo_id, unnest(list_transform(evidence, lambda e: e.to_id)), recorded_at FROM depends_on
  UNION ALL SELECT 'ambiguous_calls', repo_id, unnest(candidates), recorded_at FROM ambiguous_calls),
r AS (SELECT DISTINCT *, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS period FROM refs WHERE ref_id IS NOT NULL),
sights AS (SELECT repo_id, id, extracted_at, deleted_at, strftime(extracted_at AT TIME ZONE 'UTC', '%Y-%m') AS m FROM symbols),
months AS (SELECT period AS as_of FROM r UNION SELECT m FROM sights),
par AS (SELECT as_of, repo_id, id, min(extracted_at) AS first_at, arg_max(coalesce(deleted_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), extracted_at) AS gone FROM months JOIN sights ON m <= as_of GROUP BY ALL),
sh AS (SELECT id, min(extracted_at) AS first_at, arg_max(coalesce(deleted_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), extracted_at) AS gone FROM shared_symbols GROUP BY id),
found AS (SELECT DISTINCT a.as_of, r.tab, r.period, r.repo_id, r.ref_id,
  CASE WHEN coalesce(p.id, s.id) IS NULL THEN 'missing' WHEN coalesce(p.first_at, s.first_at) > r.recorded_at THEN 'late' WHEN coalesce(p.gone, s.gone) <= r.recorded_at THEN 'deleted' END AS state
  FROM months a JOIN r ON r.period <= a.as_of LEFT JOIN par p ON p.as_of = a.as_of AND p.repo_id = r.repo_id AND p.id = r.ref_id LEFT JOIN sh s ON s.id = r.ref_id),
kinds AS (SELECT DISTINCT tab, period, state FROM found WHERE state IS NOT NULL),
counts AS (SELECT a.as_of, k.tab, k.period, k.state, count(f.ref_id) AS orphans FROM months a CROSS JOIN kinds k LEFT JOIN found f ON f.as_of = a.as_of AND f.tab = k.tab AND f.period = k.period AND f.state = k.state GROUP BY ALL),
steps AS (SELECT *, lag(orphans, 1, 0) OVER (PARTITION BY tab, period, state ORDER BY as_of) AS before FROM counts)
SELECT as_of, tab, period, state, orphans FROM steps WHERE orphans <> before"""

ORACLES = {
    "p2_found": _P2,
    "p2_counts": f"SELECT tab, repo_id, rev, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM ({_P2}) GROUP BY ALL",
    "p4_found": _P4 + " SELECT repo_id, rev, path FROM found",
    "p4_per_run": _P4 + " SELECT d.repo_id, d.rev, d.seq, count(f.path) AS n_files FROM done d LEFT JOIN found f USING (repo_id, rev) GROUP BY ALL",
    "p5_found": _TREE + " SELECT repo_id, id FROM linked ANTI JOIN tree USING (repo_id, id)",
    "p5_tree": _TREE + """, up AS (SELECT repo_id, id, id AS a FROM linked SEMI JOIN tree USING (repo_id, id) UNION ALL SELECT u.repo_id, u.id, l.p FROM up u JOIN linked l ON l.repo_id = u.repo_id AND l.id = u.a WHERE l.p IS NOT NULL),
        n AS (SELECT repo_id, a AS id, count(*) - 1 AS n_descendants FROM up GROUP BY ALL)
        SELECT l.repo_id, l.id, t.path, t.depth, t.root_id, n.n_descendants FROM linked l LEFT JOIN tree t USING (repo_id, id) LEFT JOIN n USING (repo_id, id)""",
    "p5_descendants": _TREE + " SELECT repo_id, root_id AS id, id AS descendant FROM tree WHERE depth > 0",
    "p5_all_descendants": _TREE + """, up AS (SELECT repo_id, id, p AS a FROM linked SEMI JOIN tree USING (repo_id, id) WHERE p IS NOT NULL UNION ALL SELECT u.repo_id, u.id, l.p FROM up u JOIN linked l ON l.repo_id = u.repo_id AND l.id = u.a WHERE l.p IS NOT NULL)
        SELECT repo_id, a AS id, id AS descendant FROM up""",
    "p6_found": f"WITH {_REFS} SELECT tab, period, repo_id, ref_id, state FROM found WHERE state IS NOT NULL",
    "p6_counts": f"WITH {_REFS} SELECT tab, period, state, count(*) AS orphans FROM found WHERE state IS NOT NULL GROUP BY ALL",
    "p6_monthly": _MONTHLY,
    "p7_found": """SELECT 'edges' AS tab, to_id FROM edges WHERE to_id IS NOT NULL GROUP BY to_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)
        UNION ALL SELECT 'depends_on', to_id FROM depends_on WHERE to_id IS NOT NULL GROUP BY to_id HAVING sum(weight) >= 0.02 * (SELECT sum(weight) FROM depends_on)""",
    "p7_keys": """SELECT coalesce(e.to_id, d.to_id) AS to_id, n_rows, n_callers, weight
        FROM (SELECT to_id, count(*) AS n_rows, count(DISTINCT from_id) AS n_callers FROM edges WHERE to_id IS NOT NULL GROUP BY 1) e
        FULL JOIN (SELECT to_id, sum(weight)::BIGINT AS weight FROM depends_on WHERE to_id IS NOT NULL GROUP BY 1) d ON e.to_id = d.to_id""",
    "p7_joined": """SELECT s.kind, count(*) AS n_rows, count(e.to_id) AS n_targets FROM edges e LEFT JOIN (SELECT id, arg_max(kind, extracted_at) AS kind FROM shared_symbols GROUP BY id) s ON s.id = e.to_id GROUP BY 1""",
}
