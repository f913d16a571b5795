"""Queries on texts over whole tables, and the SQL they are held against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import at_snapshot, clean_kind, last_snapshot, latest_rows, table
from graphloom.llm import leaks, pairs, spam, tokenize


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The methods and constructors of the last snapshot with what their documentation says."""
    nodes = at_snapshot(table(spark, d, "nodes"), last_snapshot(spark, d)).select("id", clean_kind().alias("kind"), "signature", "doc", "file", "start_line", "end_line", "loaded_at")
    return pairs.function_pairs(latest_rows(nodes, ["id"]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, characters and documents per source; a document's text that is null has no characters."""
    docs = table(spark, d, "documents")
    counted = p6_ids(spark, d).select("doc_id", F.size("ids").alias("n_ids"))
    return docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(counted, "doc_id").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"), F.sum("n_ids").alias("n_ids"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked, the documents that hold a passage of it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.flagged(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per document its words, and those in link lists, tag lists and menus."""
    return spam.shares(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p6_ids, p6_counts, p7_found, p7_items, p8_found, p8_shares)}
ORACLE: dict[str, str] = {}
