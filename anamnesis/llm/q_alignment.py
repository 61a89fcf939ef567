"""Query of tokenizers' alignment. SQL has no tokenizers; tests compare with a plain version."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.alignment import align
from anamnesis.llm.common import table


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
