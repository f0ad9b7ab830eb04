"""Incremental scanning, an addition of this engine: new blocks as a stream against known references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import grams, least_sha1


def first_deliveries(stream: DataFrame, key: str = "block_key", at: str = "ingested_at", late: str = "1 day") -> DataFrame:
    """The stream with redelivered rows dropped while the watermark remembers their key."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def known_blocks(stream: DataFrame, references: DataFrame, text: str = "content") -> DataFrame:
    """Stream rows whose least item hash some reference block has, with the reference's id."""
    keyed = stream.withColumn("group_key", least_sha1(grams(F.col(text))))
    known = references.select(F.col("id").alias("ref_id"), least_sha1(grams(F.col("content"))).alias("group_key")).where("group_key IS NOT NULL")
    return keyed.join(known, "group_key")
