"""A body of documents as memories, with duplicates as evidence and unwanted contents kept out.

``python -m jobs.knowledge DOCUMENTS LABELS OUTPUT`` reads documents (``doc_id, text, lang, source``) and labels
(``doc_id, quality, toxic``), both Parquet, and writes below ``OUTPUT``:

- ``memories`` (partitioned by ``domain``, the language): one row per content, as the document with the smallest id has it
  after cleaning; documents with the same content, whatever their case, white space and punctuation, count as evidence;
- ``tombstones``: digests of contents that a document labelled toxic has; no document with such a content becomes a memory;
- ``cards`` (one row per domain): counts, evidence, and a hash by which the next reader sees whether the domain changed.

A run replaces all three, so that it can be run again at any time, with the same result from the same tables.

Plan: cleaned contents are checkpointed once; groups are decided on ids, digests and labels alone, with
partial sums, so a content that a third of the documents share is no hot task; texts move once, for
the join with what was decided.

Defined cases: documents without an id or without text after cleaning are left out and counted; several labels of a
document count as the highest of each; the same id with several contents gives each of them; rows that repeat
are evidence (of languages and sources under one id the least is shown); columns besides those named are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.deploy import durable, ship
from anamnesis.functions import text as T

log = logging.getLogger("knowledge")

MEMORIES = "id long, digest string, source string, evidence long, sources long, confidence double, content string, summary string, domain string"

#: Confidence by label, and without one.
GOOD, POOR, UNKNOWN = 0.9, 0.3, 0.5


def cleaned(documents: DataFrame) -> DataFrame:
    """``id, lang, source, content, digest`` of documents that have an id and say something. These are told after contents are
    checkpointed; a filter before would be planned below the cleaning, which would then be done once more for it."""
    content = T.scrub(T.clean(T.strip_envelope(F.coalesce("text", F.lit("")))))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "lang", "source", content.alias("content"))
    return durable(rows.where("id IS NOT NULL").withColumn("digest", T.digest(F.col("content")))).where("content != ''")


def decided(keys: DataFrame, labels: DataFrame, most_evidence: int) -> tuple[DataFrame, DataFrame]:
    """The memory of each content (all but its text), and the digests kept out."""
    of = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = keys.join(of, "id", "left")
    groups = labelled.groupBy("digest").agg(
        F.count("*").alias("documents"),
        F.min(F.struct("id", "lang", "source", "quality")).alias("head"),
        F.size(F.collect_set("source")).cast("long").alias("sources"),  # as many as there are sources
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    confidence = F.when(F.col("head.quality") == 1, GOOD).when(F.col("head.quality") == 0, POOR).otherwise(UNKNOWN)
    kept = groups.where("toxic = 0").select(
        "head.id", "digest", F.col("head.lang").alias("domain"), "head.source",
        F.least("documents", F.lit(most_evidence)).cast("long").alias("evidence"), "sources", confidence.alias("confidence"),
    )
    return kept, groups.where("toxic != 0").select("digest", "documents")


def memories_of(contents: DataFrame, kept: DataFrame, summary_chars: int) -> DataFrame:
    """Contents of the documents that stand for their group, once each; of texts that differ under one id and
    digest the least."""
    rows = contents.select("id", "digest", "content").join(kept, ["id", "digest"])
    rows = rows.groupBy(*kept.columns).agg(F.min("content").alias("content"))  # the join's partitions serve
    first = F.regexp_extract("content", r"^[^\n]*", 0)
    return rows.withColumn("summary", T.clip(T.squeeze(first), summary_chars))


def cards_of(memories: DataFrame) -> DataFrame:
    """One row per domain; the sum of hashes doesn't depend on any order."""
    mark = F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")
    return memories.groupBy("domain").agg(F.count("*").alias("memories"), F.sum("evidence").alias("evidence"), F.sum(mark).cast("string").alias("hash"))


def run(spark: SparkSession, documents: str, labels: str, output: str, most_evidence: int = 100, summary_chars: int = 60) -> dict[str, int]:
    """Write memories, tombstones and cards; returns what was read and written."""
    ship(spark)
    given = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    contents = cleaned(given)
    kept, stones = decided(contents.select("id", "lang", "source", "digest"), spark.read.parquet(labels).select("doc_id", "quality", "toxic"), most_evidence)
    memories_of(contents, kept, summary_chars).write.mode("overwrite").partitionBy("domain").parquet(f"{output}/memories")
    stones.write.mode("overwrite").parquet(f"{output}/tombstones")
    memories = spark.read.schema(MEMORIES).parquet(f"{output}/memories")
    cards_of(memories).write.mode("overwrite").parquet(f"{output}/cards")
    counts = {"read": given.count(), "said_something": contents.count(), "memories": memories.count(), "tombstones": spark.read.parquet(f"{output}/tombstones").count()}
    log.info("read %s and %s, wrote %s: %s", documents, labels, output, counts)
    return counts


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output: memories with their domain's card, and tombstones."""
    memories, cards = spark.read.schema(MEMORIES).parquet(f"{output}/memories"), spark.read.parquet(f"{output}/cards")
    card = F.struct(F.col("memories").alias("n"), F.col("evidence").alias("all"), "hash").alias("card")
    cards = cards.select(F.col("domain").alias("_domain"), card)  # as many rows as domains
    rows = memories.join(F.broadcast(cards), F.col("domain").eqNullSafe(F.col("_domain"))).drop("_domain")
    shown = rows.select(
        F.lit("memory").alias("part"), "id", "domain", "source", "summary", "content", "digest", "evidence", "sources", "confidence",
        F.col("card.n").alias("in_domain"), F.col("card.all").alias("domain_evidence"), F.col("card.hash").alias("domain_hash"),
    )
    stones = spark.read.parquet(f"{output}/tombstones").select(F.lit("tombstone").alias("part"), "digest", F.col("documents").alias("evidence"))
    return shown.unionByName(stones, allowMissingColumns=True)


if __name__ == "__main__":
    from jobs.command import main

    main(
        "knowledge",
        run,
        {"documents": "Parquet table of documents", "labels": "Parquet table of labels", "output": "folder to write to"},
        "jobs/knowledge.json",
    )
