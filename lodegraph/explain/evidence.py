"""Numbered facts behind many answers at once, the texts written from them, and checks of texts that others wrote.

An answer ``q`` rests on chains of steps. Equal steps of an answer are one fact,
numbered by first use. Everything is column expressions: texts of any number of
answers are written and checked in one pass over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_KEY = ["source", "target", "kind"]
#: Chains told of what a change can affect.
TOLD = 8
#: How a step reads; {a} and {b} are its ends, {at} its place.
WORDING = {
    "calls": "`{a}` makes a call to `{b}` in {at}",
    "dispatches_to": "whoever calls the trait method `{a}` may run `{b}`, see {at}",
    "implements": "`{a}` is written in {at} as an implementation of `{b}`",
    "may_call": "one call of `{a}` in {at} has several candidates, `{b}` among them",
}
# fixed values: stems of words that make a sentence a statement about a relationship
RELATION_STEMS = ("call", "depend", "dispatch", "implement", "reach", "affect", "invoke", "use")


def short_name(kind: Column, qualified: Column) -> Column:
    """The last segment of a name, for a method with that of its type."""
    parts = F.split(qualified, "::")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - F.when(kind == "method", 1).otherwise(0)), F.lit(2)), "::")


def number_facts(steps: DataFrame) -> DataFrame:
    """steps: q, chain, pos, source, target, kind, file, lines. (q, fact, n, STEP_KEY, file, lines): one row for each distinct step of an answer."""
    once = steps.groupBy("q", *STEP_KEY).agg(F.min(F.struct("chain", "pos", "file", "lines")).alias("u"))
    n = F.row_number().over(Window.partitionBy("q").orderBy("u.chain", "u.pos", *STEP_KEY))
    return once.withColumn("n", n).select("q", F.concat(F.lit("E"), "n").alias("fact"), "n", *STEP_KEY, "u.file", "u.lines")


def fact_texts(facts: DataFrame, names: DataFrame) -> DataFrame:
    """names: id, kind, qualified_name. The facts with ``text``; ids without a name stand for themselves."""
    named = lambda end: names.select(F.col("id").alias(end), short_name(F.col("kind"), F.col("qualified_name")).alias(f"{end}_name"))
    both = facts.join(named("source"), "source", "left").join(named("target"), "target", "left")
    at = F.when(F.size("lines") > 0, F.concat_ws(":", "file", F.array_join("lines", ","))).otherwise(F.col("file"))
    text = F.create_map(*[x for k, t in WORDING.items() for x in (F.lit(k), F.lit(t))])[F.col("kind")]
    for name, value in (("{a}", F.coalesce("source_name", "source")), ("{b}", F.coalesce("target_name", "target")), ("{at}", F.coalesce(at, F.lit("an unknown place")))):
        text = F.replace(text, F.lit(name), value)
    return both.select("q", "fact", "n", *STEP_KEY, "file", "lines", text.alias("text"))


def best_chains(certain: DataFrame, possible: DataFrame, back: DataFrame) -> DataFrame:
    """Each: q, chain, pos and a step. The steps that answer why, with ``status``: certain ones, else possible ones, else those the other way round, which show no effect."""
    ranked = None
    for rank, (status, df) in enumerate((("sufficient", certain), ("possible", possible), ("insufficient", back))):
        one = df.select("q", "chain", "pos", *STEP_KEY, "file", "lines", F.lit(rank).alias("rank"), F.lit(status).alias("status"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = F.min("rank").over(Window.partitionBy("q"))
    return ranked.withColumn("best", best).where("rank = best").drop("rank", "best")


def telling(affected: DataFrame, told: int = TOLD) -> DataFrame:
    """affected: q, nid, depth, is_test. The chains worth telling: direct dependents, then tests, then the rest, each by nid; ``chain`` is their rank."""
    group = F.when(F.col("depth") == 1, 0).when(F.col("is_test"), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(group, "depth", "nid"))
    return affected.withColumn("chain", rank).where(F.col("chain") <= told)


def _cited(fact: Column, text: Column) -> Column:
    return F.concat(text, F.lit(" ["), fact, F.lit("]."))


def write_answers(questions: DataFrame, steps: DataFrame, facts: DataFrame) -> DataFrame:
    """questions: q, status, head, note (may be null). (q, text): the head, then each chain with its facts cited, then the note."""
    told = steps.join(facts.select("q", *STEP_KEY, "fact", F.col("text").alias("said")), ["q", *STEP_KEY])
    line = F.array_sort(F.collect_list(F.struct("pos", "fact", "said")))
    chains = told.groupBy("q", "chain").agg(F.array_join(F.transform(line, lambda s: _cited(s["fact"], s["said"])), " ").alias("line"))
    body = chains.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "line"))), lambda c: F.concat(F.lit("- "), c["line"])), "\n").alias("body"))
    lead = F.when(F.col("status") == "sufficient", F.col("head")).when(F.col("status") == "possible", F.concat("head", F.lit(" Only calls of uncertain target lead there."))).otherwise(F.lit("The graph shows no such effect."))
    return questions.join(body, "q", "left").select("q", F.concat_ws("\n", lead, "body", "note").alias("text"))


def check_answers(answers: DataFrame, facts: DataFrame, names: DataFrame) -> DataFrame:
    """answers: q, text. names: q, id, kind, qualified_name, file. (q, accepted, cited, problems, warnings).

    A text is not accepted where it is blank, cites what is no fact of its
    answer, cites nothing though there are facts, or states a relationship with
    code that its answer does not name. Code named elsewhere, and statements
    without a citation, are warnings. Code is what stands in backticks, and
    paths with ``::``. A null text is blank; an answer without facts may cite none.
    """
    known_facts = facts.groupBy("q").agg(F.collect_set("fact").alias("facts"))
    spellings = F.array(short_name(F.col("kind"), F.col("qualified_name")), F.col("qualified_name"), F.element_at(F.split("qualified_name", "::"), -1), F.col("file"))
    known_names = names.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list(spellings))).alias("names"), F.collect_set("qualified_name").alias("paths"))
    text = F.coalesce("text", F.lit(""))
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), F.trim), lambda s: s != "")

    def read(s: Column) -> Column:
        brackets = F.array_join(F.regexp_extract_all(s, F.lit(r"\[([E\d,; ]+)\]"), F.lit(1)), ",")
        ticked = F.transform(F.regexp_extract_all(s, F.lit("`([^`]+)`"), F.lit(1)), F.trim)
        bare = F.regexp_extract_all(F.regexp_replace(s, "`[^`]*`", " "), F.lit(r"(?<![\w:])(\w+(?:::\w+)+)"), F.lit(1))
        relates = F.lower(s).rlike("|".join(RELATION_STEMS))
        return F.struct(s.alias("s"), F.regexp_extract_all(brackets, F.lit(r"(E\d+)"), F.lit(1)).alias("cites"), F.concat(ticked, bare).alias("code"), relates.alias("relates"))

    def is_known(c: Column) -> Column:
        plain = F.regexp_replace(c, r"\(\)$", "")
        return F.array_contains(F.col("names"), plain) | F.array_contains(F.col("names"), F.split(plain, ":")[0]) | F.exists("paths", lambda p: F.endswith(p, F.concat(F.lit("::"), plain)))

    joined = answers.join(known_facts, "q", "left").join(known_names, "q", "left")
    none = F.array().cast("array<string>")
    at = joined.select("q", text.alias("text"), F.coalesce("facts", none).alias("facts"), F.coalesce("names", none).alias("names"), F.coalesce("paths", none).alias("paths"), F.transform(sentences, read).alias("read"))
    cites = F.array_distinct(F.flatten(F.col("read.cites")))
    stranger = lambda relates: F.flatten(F.transform(F.filter("read", lambda r: r["relates"] == F.lit(relates)), lambda r: F.filter(r["code"], lambda c: ~is_known(c))))
    tell = lambda items, words: F.transform(items, lambda c: F.format_string(words, c))
    problems = F.array_compact(F.concat(
        F.array(F.when(F.trim("text") == "", F.lit("blank text"))),
        tell(F.array_except(cites, F.col("facts")), "no fact is numbered %s"),
        F.array(F.when((F.trim("text") != "") & (F.size(cites) == 0) & (F.size("facts") > 0), F.lit("no fact is cited"))),
        tell(stranger(True), "`%s` is related to other code but not part of the evidence"),
    ))
    uncited = F.transform(F.filter("read", lambda r: r["relates"] & (F.size(r["cites"]) == 0)), lambda r: r["s"])
    warnings = F.concat(tell(stranger(False), "`%s` is not part of the evidence"), tell(uncited, "without a citation: %s"))
    return at.select("q", (F.size(problems) == 0).alias("accepted"), F.array_sort(F.array_intersect(cites, F.col("facts"))).alias("cited"), F.array_distinct(problems).alias("problems"), F.array_distinct(warnings).alias("warnings"))


def choose(written: DataFrame, offered: DataFrame, verdicts: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, text, source): the text that a model offered where it was accepted and the evidence is not insufficient, else the written one."""
    j = written.join(questions.select("q", "status"), "q").join(offered.select("q", F.col("text").alias("offer")), "q", "left").join(verdicts.select("q", "accepted"), "q", "left")
    take = F.coalesce(F.col("accepted") & F.col("offer").isNotNull() & (F.col("status") != "insufficient"), F.lit(False))
    return j.select("q", F.when(take, F.col("offer")).otherwise(F.col("text")).alias("text"), F.when(take, "model").otherwise("template").alias("source"))
