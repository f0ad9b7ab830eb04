"""The training-data queries over a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, cutoff, leak, neardup, pieces, secrets, spans, syntax
from .sql import SQL  # noqa: F401


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at which a piece of an oversized block may naturally begin: the operator's cuts of the greatest strength."""
    return pieces.boundaries(table(spark, sf_dir, "code_blocks"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized blocks."""
    return pieces.pieces(table(spark, sf_dir, "code_blocks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different blocks of at least 40 tokens with similarity 0.6 or more; equal contents are pairs too."""
    blocks = table(spark, sf_dir, "code_blocks", "block_key", "content", "ingested_at")
    pairs, members = neardup.similar_texts(blocks, "block_key", "content", "ingested_at")
    copied = neardup.among(blocks, "block_key", "content", members)
    return neardup.expand(pairs, members, neardup.long_enough(copied, "block_key", "content"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block that is similar or equal to another: its group and its number of similar blocks."""
    blocks = table(spark, sf_dir, "code_blocks", "block_key", "content", "ingested_at")
    pairs, members = neardup.similar_texts(blocks, "block_key", "content", "ingested_at")
    copied = neardup.among(blocks, "block_key", "content", members)
    eligible = neardup.long_enough(copied, "block_key", "content").distinct()
    return neardup.groups(pairs, members, eligible).withColumnRenamed("key", "block_key")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of blocks on which a credential begins."""
    return secrets.secret_lines(table(spark, sf_dir, "code_blocks", "block_key", "file_path", "content"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks with credentials, these replaced and all else unchanged."""
    return secrets.redacted(table(spark, sf_dir, "code_blocks", "block_key", "file_path", "content"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files that are not valid in their language."""
    return syntax.invalid_files(table(spark, sf_dir, "code_blocks"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of invalid files per repository and language."""
    return syntax.rates(table(spark, sf_dir, "code_blocks"), table(spark, sf_dir, "trees"))


def records_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and knowledge records with their long text under one key: twice the block_key, or twice the knowledge_key and one."""
    blocks = table(spark, sf_dir, "code_blocks", "block_key", "content", "ingested_at")
    known = table(spark, sf_dir, "vuln_knowledge", "knowledge_key", "patch_diff", "ingested_at")
    rows = lambda df, key, text, odd: df.select((F.col(key) * 2 + odd).alias("rec"), F.col(text).alias("text"), "ingested_at")
    return rows(blocks, "block_key", "content", 0).unionByName(rows(known, "knowledge_key", "patch_diff", 1))


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that shares a span of 200 or more characters with another, and how many of its characters are shared."""
    lengths = spans.shared_lengths(records_with_text(spark, sf_dir), "rec", "text", "ingested_at")
    known = F.col("rec") % 2 == 1
    return lengths.select(F.when(known, "vuln_knowledge").otherwise("code_blocks").alias("rec_table"), F.shiftright("rec", 1).alias("rec_key"), "shared_chars")


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal shared spans of each different text, each with one partner record."""
    found = spans.maximal_spans(records_with_text(spark, sf_dir), "rec", "text", "ingested_at")
    table_of = lambda c: F.when(F.col(c) % 2 == 1, "vuln_knowledge").otherwise("code_blocks")
    return found.select(table_of("rec").alias("rec_table"), F.shiftright("rec", 1).alias("rec_key"), F.col("begin").alias("begin_char"), F.col("end").alias("end_char"), table_of("partner").alias("partner_table"), F.shiftright("partner", 1).alias("partner_key"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of p5_shared."""
    return p5_shared(spark, sf_dir).select("rec_table", "rec_key").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return bpe.token_ids(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items by document, with the longest run of consecutive words and the item's words."""
    return leak.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an item of which it holds 12 consecutive words or more."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return cutoff.cut_off(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return cutoff.rates(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_shared": p5_shared, "p5_spans": p5_spans, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_rates": p8_rates}

