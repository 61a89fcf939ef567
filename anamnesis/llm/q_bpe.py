"""Query of BPE encoding and decoding. SQL cannot express it; tests hold it against the
``tokenizers`` library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.bpe import encode_and_decode
from anamnesis.llm.common import table


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
