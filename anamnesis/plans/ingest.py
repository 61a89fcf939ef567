"""Writing outside the nightly run: one memory that is stated, or one text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.deploy import durable
from anamnesis.operators.merging import apply_actions, inserted, sequenced, valid_decisions, verified
from anamnesis.plans.judge import Judge

CANDIDATE = "index long, kind string, domain string, summary string, content string, keywords array<string>, origin string, confidence double, source string"


@dataclass
class Written:
    """What a write comes to: rows to add to the store, or the whole store anew; and the log."""

    added: DataFrame | None
    memories: DataFrame | None
    log: DataFrame

    def whole(self, before: DataFrame) -> DataFrame:
        return self.memories if self.memories is not None else before.unionByName(self.added)


def written(memories: DataFrame, actions: DataFrame, tombstones: DataFrame, at: Column) -> Written:
    """A batch of actions carried out. One that only inserts leaves the other rows alone."""
    if actions.where("action != 'NEW'").limit(1).count():
        return Written(None, *apply_actions(memories, actions, tombstones, at))
    rows, log = inserted(memories, actions, tombstones, at)
    return Written(durable(rows), None, durable(log))


def remember(memories: DataFrame, tombstones: DataFrame, judge: Judge, candidate: dict, at: Column, owner: str = "default", cwd: str | None = None) -> Written:
    """One stated memory written. The judge may merge it with an old one; of
    its decisions the first counts, and without any the memory is new."""
    spark = memories.sparkSession
    row = tuple(candidate.get(k) for k in ("kind", "domain", "summary", "content", "keywords", "origin", "confidence", "source"))
    found = spark.createDataFrame([(0, *row)], CANDIDATE).withColumn("owner", F.lit(owner))
    decided = valid_decisions(judge.decide("merge", found), found, memories).orderBy("_row").limit(1)
    new = found.select("index", F.lit("NEW").alias("action"), F.lit(None).cast("long").alias("target_id"), "kind", "domain", "summary", "content", "keywords", "owner", F.lit(0).cast("long").alias("_row"))
    decided = durable(decided.select(*new.columns))
    return written(memories, durable(sequenced(durable(new) if decided.isEmpty() else decided, found, cwd)), tombstones, at)


def ingest_text(memories: DataFrame, tombstones: DataFrame, judge: Judge, text: str, source: str, at: Column, owner: str = "default") -> Written:
    """One text through triage, extraction, checks and merging."""
    spark = memories.sparkSession
    segment = spark.createDataFrame([(source, 0, text)], "path string, segment long, text string")
    worth = judge.decide("triage", segment).where("worth").select("path", "segment")
    reading = segment.join(worth, ["path", "segment"], "left_semi")
    found = durable(judge.decide("extract", reading).withColumns({"owner": F.lit(owner), "source": F.lit(source)}))
    found = durable(verified(found, judge.decide("verify", found)))
    decided = durable(valid_decisions(judge.decide("merge", found), found, memories))
    return written(memories, durable(sequenced(decided, found, None)), tombstones, at)
