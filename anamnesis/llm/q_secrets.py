"""Query of secret scans. SQL cannot express the worklist; tests hold the base spans
against a direct reading of their definition and the layers against planted cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import table
from anamnesis.llm.secrets import KINDS, scan_secrets


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["path"] == F.lit(""))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_unwrapped"),
    )
