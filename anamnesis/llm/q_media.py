"""Query of media columns. SQL cannot express the transform; tests hold the round trip
and the peaks against direct computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import table
from anamnesis.llm.media import media_columns


def op3_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the last part has the sound and the digest of all pairs
    out = media_columns(table(spark, sf_dir, "documents")).where("last")
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.lit("pairs"), "n_pairs", "pairs_sha256").alias("feature"),
    )
