"""Query of personal-data pseudonyms. Tests hold it against a plain computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import table
from anamnesis.llm.pii import pseudonym_rows

#: The setting that holds the secret; without it the demonstration's is used.
SECRET, DEMO = "spark.anamnesis.pseudonym.secret", "demonstration key"


def secret(spark: SparkSession) -> str:
    return spark.conf.get(SECRET, DEMO)


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_rows(table(spark, sf_dir, "documents"), secret(spark))
