"""Queries of problems 3, 6, 7 and 8 over whole tables, and the SQL of those parts that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.llm.handwritten import judged_sources, not_handwritten
from depweft.llm.mixing import margins_report, mixture, shares_report
from depweft.llm.packing import containers, fill_report
from depweft.llm.pii import personal_data, redacted
from depweft.session import tables


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, file_types, documents, library = tables(spark, d, "nodes", "file_types", "documents", "library_files")
    return not_handwritten(nodes, file_types, documents, library).select("node_key")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Source files that were not written by hand, counted by reason."""
    nodes, file_types, documents, library = tables(spark, d, "nodes", "file_types", "documents", "library_files")
    return not_handwritten(nodes, file_types, documents, library).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The same files counted by reason and by what shows it."""
    nodes, file_types, documents, library = tables(spark, d, "nodes", "file_types", "documents", "library_files")
    return judged_sources(nodes, file_types, documents, library).groupBy("reason", "evidence").agg(F.count(F.lit(1)).alias("n_files"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    documents, pack_sizes = tables(spark, d, "documents", "pack_sizes")
    return containers(documents, pack_sizes)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    documents, pack_sizes = tables(spark, d, "documents", "pack_sizes")
    return fill_report(containers(documents, pack_sizes), pack_sizes)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    documents, mix_weights = tables(spark, d, "documents", "mix_weights")
    return mixture(documents, mix_weights)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    documents, mix_weights = tables(spark, d, "documents", "mix_weights")
    return shares_report(mixture(documents, mix_weights), mix_weights)


def p7_margins(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every source, language and topic."""
    documents, mix_weights = tables(spark, d, "documents", "mix_weights")
    return margins_report(documents, mix_weights)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = tables(spark, d, "documents")
    return personal_data(documents)


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    (documents,) = tables(spark, d, "documents")
    return redacted(documents)


QUERIES = {f.__name__: f for f in (p3_found, p3_reasons, p3_evidence, p6_containers, p6_fill, p7_mixture, p7_shares, p7_margins, p8_found, p8_redacted)}
SQL: dict[str, str] = {}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
