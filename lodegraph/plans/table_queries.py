"""Queries over the fact tables: languages, outcomes, comparison of revisions, range joins, text functions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.analyses import store
from lodegraph.compare import symbols as compare
from lodegraph.functions import text
from lodegraph.graph.frame import live_symbols, merged_edges
from lodegraph.operators import ranges
from lodegraph.plans.dealt import runs
from lodegraph.quality import measures
from lodegraph.tables import plain_path, table

#: The instant that parts the base revision of symbols from their head.
CUT = "2025-02-01 00:00:00"


def language_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Files and lines per language in each repository's last full snapshot, by the language of the path."""
    last = runs(spark, folder).where("status is null or status <> 'aborted'").groupBy("repo_id").agg(F.max_by("rev", "seq").alias("rev"))
    own = table(spark, folder, "files").select("repo_id", "rev", plain_path(F.col("path")).alias("path"), "loc", "observed_at").where("path is not null").join(last, ["repo_id", "rev"])
    one = own.groupBy("repo_id", "path").agg(F.max(F.struct("observed_at", "loc")).alias("r"))
    return one.groupBy("repo_id", text.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("r.loc").alias("loc"))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with text per source and language."""
    d = table(spark, folder, "documents")
    return d.groupBy("source", "language").agg(F.count("*").alias("n_documents"), F.sum(text.nonblank_lines(F.col("text"))).alias("loc"))


def second_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines 2 to 4 of every text."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.explode(text.lines_between(F.col("text"), 2, 4)).alias("l")).select("doc_id", "l.line", "l.text")


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The content hash of every source file's text."""
    d = table(spark, folder, "documents").where("source = 'source_file'")
    return d.select("doc_id", text.content_hash("text").alias("content_hash"))


def generated_names(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("source = 'source_file'")
    return d.groupBy("repo_id").agg(F.count_if(text.is_generated_name(F.col("path"))).alias("by_name"), F.count_if(text.has_generated_header(F.col("text"))).alias("by_header"))


def name_forms(spark: SparkSession, folder: str) -> DataFrame:
    s = live_symbols(table(spark, folder, "symbols"))
    return s.select("repo_id", "id", text.short_name(F.col("kind"), F.col("qualified_name")).alias("short"), text.qualified_of(F.col("id")).alias("qualified"), F.split_part("qualified_name", F.lit("::"), F.lit(1)).alias("crate"))


def repository_list(spark: SparkSession, folder: str) -> DataFrame:
    r = store.repositories(table(spark, folder, "repositories"))
    return r.select("repo_id", "name", text.name_of_url(F.col("origin_url")).alias("url_name"), F.coalesce(text.is_remote(F.col("origin_url")), F.lit(False)).alias("remote"), F.array_join(F.transform("languages", lambda x: x["language"]), ",").alias("languages"))


def call_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved and ambiguous calls of each repository, and the rate of resolved ones."""
    e = merged_edges(table(spark, folder, "edges")).where("relation = 'CALLS'").groupBy("repo_id").agg(F.count("*").alias("resolved"), *[F.count_if(F.col("resolution") == s).alias(f"by_{s}") for s in ("scope", "import", "path", "receiver_type", "self_type", "impl_block")])
    a = table(spark, folder, "ambiguous_calls").select("repo_id", "caller", "callee", "line").distinct().groupBy("repo_id").agg(F.count("*").alias("ambiguous"))
    both = e.join(a, "repo_id", "full").na.fill(0)
    return both.withColumn("rate", F.round(F.try_divide("resolved", F.col("resolved") + F.col("ambiguous")), 4))


def candidate_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate edges held against the candidates that the ambiguous calls list."""
    expected = table(spark, folder, "ambiguous_calls").select("repo_id", F.col("caller").alias("from_id"), F.explode("candidates").alias("to_id"))
    actual = merged_edges(table(spark, folder, "edges")).where("relation = 'CALLS_CANDIDATE'")
    return measures.compare_sets(expected, actual, ["repo_id"], ["from_id", "to_id"])


def weight_statistics(spark: SparkSession, folder: str) -> DataFrame:
    s = measures.order_statistics(table(spark, folder, "depends_on"), ["level"], "weight")
    return s.withColumn("mean", F.round("mean", 6))


def heaviest_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """The five heaviest file dependencies out of each repository's last full snapshot."""
    last = runs(spark, folder).where("status is null or status <> 'aborted'").groupBy("repo_id").agg(F.max_by("rev", "seq").alias("rev"))
    d = table(spark, folder, "depends_on").where("level = 'file'").select("repo_id", "rev", "from_id", "to_id", "weight").distinct().join(last, ["repo_id", "rev"])
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("weight"), "to_id", "from_id"))
    return d.withColumn("place", place).where("place <= 5").select("repo_id", "place", "from_id", "to_id", "weight")


def _revisions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "symbols").where("id is not null")
    mark = F.concat_ws(":", F.col("end_line") - F.col("start_line"), "is_test")
    with_mark = lambda df: df.select("repo_id", "id", "kind", "name", mark.alias("fingerprint"), F.col("qualified_name").alias("signature"))
    return with_mark(live_symbols(rows.where(F.col("extracted_at") < F.lit(CUT).cast("timestamp")))), with_mark(live_symbols(rows))


def compare_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols at the cut held against all that is known now."""
    base, head = _revisions(spark, folder)
    return compare.compare(base, head)


def touched_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each symbol that the calls of its file's callers span, as hunks."""
    s = live_symbols(table(spark, folder, "symbols"))
    e = merged_edges(table(spark, folder, "edges")).where("size(lines) > 0").join(s.select("repo_id", F.col("id").alias("from_id"), "file"), ["repo_id", "from_id"])
    hunks = e.select("repo_id", "file", F.array_min("lines").alias("start"), (F.array_max("lines") - F.array_min("lines")).alias("lines")).distinct()
    return compare.touched(s, hunks).groupBy("repo_id", "id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("hunks"))


def innermost_modules(spark: SparkSession, folder: str) -> DataFrame:
    """The innermost module of each symbol's file that spans its first line."""
    s = live_symbols(table(spark, folder, "symbols"))
    modules = s.where("kind = 'module'").select("repo_id", "file", "start_line", "end_line", "id")
    points = s.where("kind <> 'module'").select("repo_id", "file", F.col("id").alias("symbol"), F.col("start_line").alias("line"))
    return ranges.innermost(points, modules, ["repo_id", "file"], "line", "start_line", "end_line", "id").select("repo_id", "symbol", F.col("owner").alias("module"))


def owning_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Files of source documents per deepest folder that holds at least three."""
    d = table(spark, folder, "documents").where("source = 'source_file' and path is not null").select("repo_id", "path").distinct()
    holder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folders = d.groupBy("repo_id", holder.alias("folder")).agg(F.count("*").alias("n")).where("n >= 3")
    return ranges.longest_prefix(d, folders, ["repo_id"], "path", "folder").groupBy("repo_id", "owner").agg(F.count("*").alias("n_files"))


def duplicate_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that equal names of one kind get in order of file and line."""
    s = live_symbols(table(spark, folder, "symbols"))
    n = ranges.numbered_duplicates(s, ["repo_id", "kind", "name"], ["file", "start_line", "id"])
    return n.select("repo_id", "id", text.symbol_id(F.col("kind"), F.col("name"), F.col("n")).alias("short_id"))


def renamed_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Call edges with their ends renamed by the moves between the revisions."""
    moves = compare_symbols(spark, folder).where("change = 'moved'").select("repo_id", F.col("previous_id").alias("from_id"), F.col("id").alias("to_id"))
    e = merged_edges(table(spark, folder, "edges")).where("relation = 'CALLS'").select("repo_id", "from_id", "to_id")
    return compare.rename_ends(e, moves, "from_id", "to_id").groupBy("repo_id").agg(F.count_distinct("from_id", "to_id").alias("n_calls"))


def last_login(spark: SparkSession, folder: str) -> DataFrame:
    """For each event of the first type the latest one of the second type of the same user up to its instant; rows without a type are of neither."""
    e = table(spark, folder, "events")
    first = e.agg(F.min("event_type")).first()[0]
    second = e.where(F.col("event_type") > first).agg(F.min("event_type")).first()[0] if first is not None else None
    left = e.where(F.col("event_type") == first).select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == second).groupBy("user_id", F.col("ts").alias("seen_at")).agg(F.max("event_id").alias("seen_event"))
    return ranges.as_of(left, right, ["user_id"], "ts", "seen_at", ["seen_event"]).select("event_id", "seen_event")


def events_by_day(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        language_stats, text_lines, second_lines, content_hashes, generated_names, name_forms, repository_list, call_outcomes, candidate_quality, weight_statistics, heaviest_dependencies, compare_symbols, touched_symbols,
        innermost_modules, owning_folders, duplicate_suffixes, renamed_ends, last_login, events_by_day,
    )
}

from lodegraph.plans.dealt import _FILES  # noqa: E402
from lodegraph.plans.graph_queries import _LIVE, _MERGED  # noqa: E402

_LANG = "CASE regexp_extract(lower(path), '\\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' END"
_LAST = "last_x AS (SELECT repo_id, arg_max(rev, seq) AS rev FROM runs_x WHERE status IS DISTINCT FROM 'aborted' GROUP BY repo_id)"
_PLAIN = r"""regexp_replace(regexp_replace(replace(path, '\', '/'), '(^|/)(\.?/)+', '\1', 'g'), '(/\.?)+$', '')"""
_REVS = """old_live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY extracted_at DESC, deleted_at DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL AND extracted_at < TIMESTAMPTZ '2025-02-01 00:00:00+00') WHERE rn = 1 AND deleted_at IS NULL),
ob AS (SELECT repo_id, id, kind, name, (end_line - start_line) || ':' || is_test AS f, qualified_name AS s FROM old_live),
nb AS (SELECT repo_id, id, kind, name, (end_line - start_line) || ':' || is_test AS f, qualified_name AS s FROM live),
added AS (SELECT * FROM nb ANTI JOIN ob USING (repo_id, id)), removed AS (SELECT * FROM ob ANTI JOIN nb USING (repo_id, id)),
moves AS (SELECT a.repo_id, r.id AS from_id, a.id AS to_id FROM (SELECT repo_id, kind, name, f, min(id) AS id FROM added WHERE f IS NOT NULL GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT repo_id, kind, name, f, min(id) AS id FROM removed WHERE f IS NOT NULL GROUP BY ALL HAVING count(*) = 1) r USING (repo_id, kind, name, f)),
chg AS (SELECT n.repo_id, n.id, NULL::VARCHAR AS previous_id, 'modified' AS change, n.s <> o.s AS signature_changed FROM nb n JOIN ob o USING (repo_id, id) WHERE n.kind <> 'module' AND n.f IS DISTINCT FROM o.f
  UNION ALL SELECT repo_id, id, NULL, 'added', false FROM added ANTI JOIN (SELECT repo_id, to_id AS id FROM moves) m USING (repo_id, id)
  UNION ALL SELECT repo_id, id, NULL, 'removed', false FROM removed ANTI JOIN (SELECT repo_id, from_id AS id FROM moves) m USING (repo_id, id)
  UNION ALL SELECT repo_id, to_id, from_id, 'moved', false FROM moves)"""
ORACLES = {
    "language_stats": f"WITH {_FILES}, {_LAST}, f AS (SELECT repo_id, path, loc FROM (SELECT repo_id, rev, {_PLAIN} AS path, loc, observed_at, row_number() OVER (PARTITION BY repo_id, rev, {_PLAIN} ORDER BY observed_at DESC NULLS LAST, loc DESC NULLS LAST) AS rn FROM files SEMI JOIN last_x USING (repo_id, rev) WHERE path IS NOT NULL) WHERE rn = 1) SELECT repo_id, {_LANG} AS language, count(*) AS files, sum(loc)::BIGINT AS loc FROM f GROUP BY ALL",
    "text_lines": "SELECT source, language, count(*) AS n_documents, sum(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\r\\f\\v]'))))::BIGINT AS loc FROM documents GROUP BY ALL",
    "second_lines": "SELECT doc_id, i AS line, regexp_replace(l[i], '\\r$', '') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), (VALUES (2), (3), (4)) v(i) WHERE i <= len(l)",
    "generated_names": """WITH d AS (SELECT repo_id, regexp_extract(path, '([^/]*)$', 1) AS n, lower(array_to_string(string_split(text, chr(10))[1:5], chr(10))) AS h FROM documents WHERE source = 'source_file')
        SELECT repo_id, count(*) FILTER (n LIKE '%.pb.rs' OR n LIKE '%.min.js' OR contains(n, '_generated.') OR contains(n, '.generated.')) AS by_name,
          count(*) FILTER (contains(h, '@generated') OR contains(h, 'do not edit') OR contains(h, 'code generated by') OR contains(h, 'automatically generated')) AS by_header FROM d GROUP BY repo_id""",
    "name_forms": f"WITH {_LIVE} SELECT repo_id, id, CASE WHEN kind = 'method' THEN array_to_string(string_split(qualified_name, '::')[-2:], '::') ELSE string_split(qualified_name, '::')[-1] END AS short, regexp_replace(id, '^[a-z]+:', '') AS qualified, split_part(qualified_name, '::', 1) AS crate FROM live",
    "repository_list": "SELECT repo_id, name, regexp_extract(regexp_replace(origin_url, '(\\.git)?/*$', ''), '([^/:]+)$', 1) AS url_name, coalesce(contains(origin_url, '://') OR regexp_matches(origin_url, '^git@[^:]+:'), false) AS remote, array_to_string(list_transform(languages, lambda x: x.language), ',') AS languages FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY analyzed_at DESC) AS rn FROM repositories) WHERE rn = 1",
    "call_outcomes": f"""WITH {_MERGED}, e AS (SELECT repo_id, count(*) AS resolved, {", ".join(f"count(*) FILTER (resolution = '{s}') AS by_{s}" for s in ("scope", "import", "path", "receiver_type", "self_type", "impl_block"))} FROM merged WHERE relation = 'CALLS' GROUP BY repo_id),
        a AS (SELECT repo_id, count(*) AS ambiguous FROM (SELECT DISTINCT repo_id, caller, callee, line FROM ambiguous_calls) GROUP BY repo_id)
        SELECT repo_id, coalesce(resolved, 0) AS resolved, {", ".join(f"coalesce(by_{s}, 0) AS by_{s}" for s in ("scope", "import", "path", "receiver_type", "self_type", "impl_block"))}, coalesce(ambiguous, 0) AS ambiguous, round(coalesce(resolved, 0) / (coalesce(resolved, 0) + coalesce(ambiguous, 0)), 4) AS rate FROM e FULL JOIN a USING (repo_id)""",
    "candidate_quality": f"""WITH {_MERGED}, x AS (SELECT DISTINCT repo_id, caller AS from_id, unnest(candidates) AS to_id FROM ambiguous_calls), y AS (SELECT DISTINCT repo_id, from_id, to_id FROM merged WHERE relation = 'CALLS_CANDIDATE'),
        j AS (SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, x.repo_id IS NOT NULL AS e, y.repo_id IS NOT NULL AS a FROM x FULL JOIN y ON x.repo_id = y.repo_id AND x.from_id = y.from_id AND x.to_id = y.to_id),
        g AS (SELECT repo_id, count(*) FILTER (e) AS expected, count(*) FILTER (a) AS actual, count(*) FILTER (e AND a) AS true_positives, count(*) FILTER (e AND NOT a) AS missing, count(*) FILTER (a AND NOT e) AS unexpected FROM j GROUP BY ALL)
        SELECT *, CASE WHEN actual > 0 THEN floor(true_positives / actual * 1000 + 0.5) / 1000 END AS precision, CASE WHEN expected > 0 THEN floor(true_positives / expected * 1000 + 0.5) / 1000 END AS recall FROM g""",
    "weight_statistics": "WITH s AS (SELECT level, list_sort(list(weight)) AS w, count(*) AS n, avg(weight) AS m FROM depends_on WHERE weight IS NOT NULL GROUP BY level) SELECT level, n, w[1] AS min, w[floor((n - 1) * 0.5 + 0.5)::BIGINT + 1] AS median, w[floor((n - 1) * 0.95 + 0.5)::BIGINT + 1] AS p95, w[-1] AS max, round(m, 6) AS mean FROM s",
    "heaviest_dependencies": f"WITH {_FILES}, {_LAST} SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY weight DESC, to_id, from_id) AS place, from_id, to_id, weight FROM (SELECT DISTINCT repo_id, rev, from_id, to_id, weight FROM depends_on WHERE level = 'file') d SEMI JOIN last_x USING (repo_id, rev) QUALIFY place <= 5",
    "compare_symbols": f"WITH {_LIVE}, {_REVS} SELECT * FROM chg",
    "touched_symbols": f"""WITH {_LIVE}, {_MERGED}, h AS (SELECT DISTINCT m.repo_id, s.file, list_min(m.lines) AS a, list_max(m.lines) - list_min(m.lines) AS n FROM merged m JOIN live s ON s.repo_id = m.repo_id AND s.id = m.from_id WHERE len(m.lines) > 0),
        t AS (SELECT s.repo_id, s.id, greatest(h.a, s.start_line) AS f, CASE WHEN n = 0 THEN h.a ELSE least(h.a + n - 1, s.end_line) END AS l FROM live s JOIN h ON h.repo_id = s.repo_id AND h.file = s.file
          WHERE (n = 0 AND s.start_line <= h.a AND h.a < s.end_line) OR (n > 0 AND h.a <= s.end_line AND h.a + n - 1 >= s.start_line))
        SELECT repo_id, id, min(f) AS first, max(l) AS last, count(*) AS hunks FROM t GROUP BY ALL""",
    "innermost_modules": f"""WITH {_LIVE} SELECT repo_id, symbol, module FROM (SELECT s.repo_id, s.id AS symbol, m.id AS module, row_number() OVER (PARTITION BY s.repo_id, s.id ORDER BY m.start_line DESC, m.end_line, m.id DESC) AS rn
        FROM live s JOIN live m ON m.repo_id = s.repo_id AND m.file = s.file AND m.kind = 'module' AND s.start_line BETWEEN m.start_line AND m.end_line WHERE s.kind <> 'module') WHERE rn = 1""",
    "owning_folders": r"""WITH d AS (SELECT DISTINCT repo_id, path FROM documents WHERE source = 'source_file' AND path IS NOT NULL), f AS (SELECT repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM d GROUP BY ALL HAVING count(*) >= 3),
        o AS (SELECT d.repo_id, d.path, f.folder, row_number() OVER (PARTITION BY d.repo_id, d.path ORDER BY length(f.folder) DESC) AS rn FROM d JOIN f ON f.repo_id = d.repo_id AND (f.folder = '' OR starts_with(d.path, f.folder || '/'))) SELECT repo_id, folder AS owner, count(*) AS n_files FROM o WHERE rn = 1 GROUP BY ALL""",
    "duplicate_suffixes": f"""WITH {_LIVE}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind, name ORDER BY file, start_line, id) AS k FROM live)
        SELECT repo_id, id, CASE kind WHEN 'module' THEN 'mod' WHEN 'function' THEN 'fn' ELSE kind END || ':' || name || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS short_id FROM n""",
    "renamed_ends": f"WITH {_LIVE}, {_MERGED}, {_REVS} SELECT m.repo_id, count(DISTINCT (coalesce(a.to_id, m.from_id), coalesce(b.to_id, m.to_id))) AS n_calls FROM merged m LEFT JOIN moves a ON a.repo_id = m.repo_id AND a.from_id = m.from_id LEFT JOIN moves b ON b.repo_id = m.repo_id AND b.from_id = m.to_id WHERE relation = 'CALLS' GROUP BY ALL",
    "last_login": "WITH t AS (SELECT DISTINCT event_type FROM events), a AS (SELECT min(event_type) AS x FROM t), b AS (SELECT min(event_type) AS y FROM t WHERE event_type > (SELECT x FROM a)), l AS (SELECT event_id, user_id, ts FROM events, a WHERE event_type = x), r AS (SELECT user_id, ts, max(event_id) AS seen_event FROM events, b WHERE event_type = y GROUP BY ALL) SELECT l.event_id, r.seen_event FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "events_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}


def _source_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from lodegraph.names.analyse import fact_tables

    d = table(spark, folder, "documents").where("source = 'source_file' and (path like '%.rs' or path = 'Cargo.toml' or path like '%/Cargo.toml')")
    return fact_tables(d.groupBy("repo_id", "path").agg(F.max_by("text", F.struct("created_at", "doc_id")).alias("text")))


def source_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols read from the Rust texts of each repository."""
    return _source_facts(spark, folder)["symbols"]


def source_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Typed edges resolved from the Rust texts of each repository."""
    return _source_facts(spark, folder)["edges"].withColumn("lines", F.concat_ws(",", F.transform("lines", lambda x: x.cast("string"))))


QUERIES |= {f.__name__: f for f in (source_symbols, source_calls)}
