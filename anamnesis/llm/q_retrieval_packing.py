"""Query of packing by retrieval. SQL cannot express it; tests check its laws and its ranking."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import table
from anamnesis.llm.retrieval_packing import pack_by_retrieval


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_retrieval(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
