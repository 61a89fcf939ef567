"""Query of best-fit packing. SQL cannot express it; tests check the packing's laws."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import table
from anamnesis.llm.packing import pack_documents


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
