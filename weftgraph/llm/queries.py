"""Queries of the text problems (p5-p8) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import abuse, chunked_encoding, packing, syntax
from weftgraph.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """file_id of the files that are not well-formed in the language of their path."""
    return syntax.found(table(spark, d, "source_files"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """file_id, repo, language, malformed, first_line, first_message, errors of every file."""
    return syntax.judge(table(spark, d, "source_files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """repo, language, n_files, n_malformed, rate."""
    return syntax.rates(syntax.judge(table(spark, d, "source_files")), "repo", "language")


def p5_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """language, n_files, n_accepted, acceptance."""
    return syntax.acceptance(syntax.judge(table(spark, d, "source_files")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k."""
    return chunked_encoding.encode_column(table(spark, d, "documents"))


def _specs(spark: SparkSession, d: str) -> list[tuple[int, str, int]]:
    return [tuple(r) for r in table(spark, d, "pack_specs").select("spec_id", "tokenizer", "capacity").collect()]  # three rows


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """spec_id, doc_id, piece_no, n_tokens, container_id."""
    return packing.pack(table(spark, d, "documents"), _specs(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """spec_id, capacity, n_documents, n_tokens, n_containers, fill."""
    specs = _specs(spark, d)
    return packing.fill(packing.pack(table(spark, d, "documents"), specs), specs)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of the documents with abusive, hateful or sexually explicit passages."""
    return _scored(spark, d).where(F.col("p_abusive") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, severity, p_abusive of every document."""
    return _scored(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """source, n_documents, n_abusive, rate, mean_severity."""
    return abuse.rates(_scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p5_found, p5_files, p5_rates, p5_acceptance, p6_ids, p7_pack, p7_fill, p8_found, p8_scores, p8_rates)}


def oracle_sql() -> dict[str, str]:
    return {}
