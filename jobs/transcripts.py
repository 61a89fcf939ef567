"""Conversations as they arrive, cleaned, with each conversation's context kept up to date.

``python -m jobs.transcripts CONVERSATIONS OUTPUT CHECKPOINT`` takes the files of ``CONVERSATIONS``
(Parquet; ``conv_id, turn, role, text``) that earlier runs haven't taken, and stops. Below ``OUTPUT``:

- ``turns`` (partitioned by ``bucket`` of the conversation and by ``batch``): each turn without injected cards, inline
  images, fenced code and access keys, with the digest of its text;
- ``contexts`` (partitioned by ``bucket``): for each conversation its counts and the text that an agent
  is given to go on with it, under a budget.

A batch writes its own partitions of ``turns`` and then the contexts of the buckets that it touched, from
``turns``. Both writes replace what the same batch wrote before, so that a batch that was cut short is done
again with the same result, and a run without new files changes nothing. ``buckets`` should be such that a
bucket's turns are some hundred megabytes; another number needs another output.

Defined cases: a turn that arrives again replaces the earlier one (in one batch, the text that sorts last wins); a
turn without text, or with none left, takes its earlier text back; rows without conversation
or number are counted and left out; columns besides the four are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.deploy import ship
from anamnesis.functions import text as T
from anamnesis.operators.conversations import CONTEXT_CHARS, context_text

log = logging.getLogger("transcripts")

TURNS = "conv_id long, turn long, role string, text string, digest string, redacted boolean, bucket int, batch long"
CONTEXTS = "conv_id long, turns long, user_turns long, chars long, redacted long, context string, bucket int"


def prepared(rows: DataFrame, buckets: int) -> DataFrame:
    """Turns as they are kept; those that can't be placed have no bucket."""
    cleaned = T.clean(T.strip_envelope(F.coalesce("text", F.lit(""))))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lower("role").alias("role"), cleaned.alias("cleaned"))
    rows = rows.withColumn("text", T.scrub(F.col("cleaned")))
    return rows.select(
        "conv_id", "turn", "role", "text", T.digest(F.col("text")).alias("digest"), (F.col("text") != F.col("cleaned")).alias("redacted"),
        F.when(placed, F.pmod(F.xxhash64("conv_id"), F.lit(buckets))).cast("int").alias("bucket"),
    )


def latest(turns: DataFrame) -> DataFrame:
    """Of each turn what arrived last, without those that have no text."""
    newest = F.max(F.struct("batch", "text", "role", "digest", "redacted")).alias("n")
    rows = turns.groupBy("bucket", "conv_id", "turn").agg(newest)
    return rows.select("bucket", "conv_id", "turn", "n.role", "n.text", "n.digest", "n.redacted", "n.batch")


def contexts(turns: DataFrame, budget: int) -> DataFrame:
    """A row per conversation of ``latest`` turns, also of those of which nothing is left."""
    said = F.col("text") != ""
    user = said & (F.col("role") == "user")
    counts = turns.groupBy("bucket", "conv_id").agg(
        F.count_if(said).alias("turns"),
        F.count_if(user).alias("user_turns"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
        F.count_if(F.col("redacted")).alias("redacted"),
    )
    asked = turns.where(user).select(F.col("conv_id").alias("topic_id"), F.col("turn").alias("reply_id"), F.col("text").alias("query"), F.lit("").alias("gist"))
    texts = context_text(asked, F.lit(""), budget).withColumnRenamed("topic_id", "conv_id")
    return counts.join(texts, "conv_id", "left").select("conv_id", "turns", "user_turns", "chars", "redacted", "context", "bucket")


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that ``rows`` has; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, conversations: str, output: str, checkpoint: str, buckets: int = 64, budget: int = CONTEXT_CHARS, most_files: int = 1000) -> dict[str, int]:
    """Take what is new in ``conversations`` and bring ``output`` up to date; returns what was read and written."""
    ship(spark)
    done = {"batches": 0, "read": 0, "left_out": 0, "turns": 0, "contexts": 0}
    columns = ["conv_id", "turn", "role", "text"]
    schema = spark.read.parquet(conversations).select(*columns).schema

    def land(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = prepared(batch, buckets)
        _replace(rows.where("bucket IS NOT NULL").withColumn("batch", F.lit(number).cast("long")), f"{output}/turns", "bucket", "batch")
        turns = own.read.schema(TURNS).parquet(f"{output}/turns")
        landed = turns.where(F.col("batch") == number)
        touched = {r.bucket: r["count"] for r in landed.groupBy("bucket").count().collect()}  # at most one row per bucket
        read, kept = batch.count(), sum(touched.values())
        if touched:
            _replace(contexts(latest(turns.where(F.col("bucket").isin(*touched))), budget), f"{output}/contexts", "bucket")
        made = own.read.schema(CONTEXTS).parquet(f"{output}/contexts").where(F.col("bucket").isin(*touched)).count() if touched else 0
        for name, n in (("batches", 1), ("read", read), ("left_out", read - kept), ("turns", kept), ("contexts", made)):
            done[name] += n
        log.info("batch %d: %d rows read from %s, %d turns and %d contexts in %d buckets written to %s", number, read, conversations, kept, made, len(touched), output)

    # a pattern that names just this path: as a plain path a stream takes folders only, and a table may be one file
    path = conversations.rstrip("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(f"{path[:-1]}[{path[-1]}]")
    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("done: %s", done)
    return done


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output: each turn as it stands now, with its conversation's counts and context."""
    turns = latest(spark.read.schema(TURNS).parquet(f"{output}/turns"))
    known = spark.read.schema(CONTEXTS).parquet(f"{output}/contexts")
    named = known.select("conv_id", F.col("turns").alias("n_turns"), "user_turns", "chars", F.col("redacted").alias("n_redacted"), "context")
    return turns.join(named, "conv_id").select("conv_id", "turn", "role", "text", "digest", "redacted", "n_turns", "user_turns", "chars", "n_redacted", "context")


if __name__ == "__main__":
    from jobs.command import main

    main(
        "transcripts",
        run,
        {"conversations": "folder of Parquet files", "output": "folder to write to", "checkpoint": "folder of the stream's progress"},
        "jobs/transcripts.json",
    )
