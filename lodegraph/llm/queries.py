"""Queries p1, p3, p8, p9 and p10, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import encoding, mixing, parsing, reading, sourcefiles
from lodegraph.session import Scratch
from lodegraph.tables import table

PROSE = ("guide", "tutorial", "design_note", "issue", "review")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sourcefiles.not_handwritten(sourcefiles.source_files(table(spark, folder, "documents"))).select("doc_id")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many files are set aside for which first reason, per language."""
    docs = sourcefiles.source_files(table(spark, folder, "documents"))
    return sourcefiles.not_handwritten(docs).join(docs.select("doc_id", "language"), "doc_id").groupBy("language", "reason").agg(F.count("*").alias("n_files"))


def p1_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    """What remains: the hand-written source files."""
    docs = sourcefiles.source_files(table(spark, folder, "documents"))
    return docs.select("doc_id", "repo_id", "path").join(sourcefiles.not_handwritten(docs), "doc_id", "left_anti")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = sourcefiles.source_files(table(spark, folder, "documents"))
    return parsing.check_syntax(docs).where("broken").select("doc_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    docs = sourcefiles.source_files(table(spark, folder, "documents"))
    return parsing.rates(docs, parsing.check_syntax(docs))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.token_ids(table(spark, folder, "documents"))


def p8_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per source and characters per token."""
    n = encoding.token_counts(table(spark, folder, "documents"), ["source", "n_chars"])
    return n.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_chars") / F.sum("n_tokens"), 4).alias("chars_per_token"))


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    counted = encoding.token_counts(table(spark, folder, "documents"), ["doc_id", "source"])
    return mixing.Mix(counted, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).rows()


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).shares()


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, lang, level, grade) of prose of any language that has words; labels are fitted on documents of the table that carry them."""
    docs = table(spark, folder, "documents").where(F.col("source").isin(*PROSE) & F.col("text").rlike(r"\S"))
    scratch = Scratch(spark, "reading")
    counted = scratch.keep(reading.text_counts(docs, ["lang"]))
    graded = counted.select("doc_id", "lang", *[c.alias(n) for n, c in reading.grade_columns().items()])
    labels = table(spark, folder, "reading_labels").where("reading_level is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    sample = graded.join(labels, "doc_id").where("lix is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(reading.MAX_LABELLED)
    steps = reading.fit(sample.toPandas())
    said = graded.withColumn("score", reading.level_column(steps))
    median = F.array_sort(F.array(*[F.col(f) for f in reading.FORMULAS if f != "lix"]))
    return said.select("doc_id", "lang", F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("score") + 0.5))).cast("int").alias("level"), F.round((median[2] + median[3]) / 2, 3).alias("grade"), F.col("lix").isNotNull().alias("has_words"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where("lang = 'en' and has_words and level >= 4").select("doc_id")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Level and median school grade of each prose document; null where it has no words."""
    docs = table(spark, folder, "documents").where(F.col("source").isin(*PROSE)).select("doc_id", "source")
    levels = _levels(spark, folder).where("has_words").select("doc_id", "level", "grade")
    return docs.join(levels, "doc_id", "left").select("doc_id", "source", "level", "grade")


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    return p10_levels(spark, folder).groupBy("source", "level").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_handwritten, p3_found, p3_rates, p8_ids, p8_per_source, p9_mix, p9_shares, p10_found, p10_levels, p10_profile)}
#: None of these can be stated in SQL: they need a parser, a tokenizer or fitted steps. tests/llm hold them against brute force.
ORACLES: dict[str, str] = {}
