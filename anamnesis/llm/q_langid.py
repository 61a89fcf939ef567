"""Query of language identification. SQL cannot express it; tests measure accuracy on
held-out rows and hold the labelling against a plain Viterbi."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import table
from anamnesis.llm.langid import held_out, identify, train


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "lang_pred",
        "score",
        "fit",
        F.size("spans").cast("long").alias("n_spans"),
    )
