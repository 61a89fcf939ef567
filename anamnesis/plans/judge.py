"""Decisions that a model makes, behind an interface.

A judge gets a step's name and a DataFrame of inputs and returns a DataFrame of decisions, with the
columns that ``DECISIONS`` names. Everything that follows from a decision is done by operators, so it
can be tested with decisions that are replayed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from anamnesis.functions.text import squeeze

#: Steps with the columns of their decisions.
DECISIONS = {
    "triage": "path string, segment long, worth boolean",
    "extract": "path string, segment long, index long, kind string, domain string, summary string, content string,"
    " keywords array<string>, origin string, confidence double",
    "verify": "index long, verdict string, confidence double, origin string",
    "merge": "index long, action string, target_id long, kind string, domain string, summary string, content string, keywords array<string>",
    "pick": "place long, id long, profile_id long",
    "inbox-filter": "path string, offset long, keep boolean",
    # op: merge (place, ids and texts), conflict (keep_id, drop_id), archive (id), retag (id, kind, domain)
    "reorganize": "op string, place long, ids array<long>, keep_id long, drop_id long, id long, kind string, domain string, summary string,"
    " content string, keywords array<string>",
    "synthesize-cluster": "domain_place long, domain string, sub_place long, sub string, member_ids array<long>",
    "synthesize-theme": "theme string, abstract string, content string",
    "reply-gist": "topic_id long, reply_id long, gist string",
    "topic-summary": "topic_id long, summary string",
    "store-card": "owner string, domain string, card string",
    "audit": "id long, verdict string, summary string, content string",
    "backfill": "id long, keywords array<string>, mini string",
}
PICKED = 20


class Judge(Protocol):
    def decide(self, step: str, inputs: DataFrame) -> DataFrame: ...


class ReplayJudge:
    """Decisions from tables, by step; a step without a table decides nothing."""

    def __init__(self, decisions: dict[str, DataFrame]):
        self.decisions = decisions

    def decide(self, step: str, inputs: DataFrame) -> DataFrame:
        if step in self.decisions:
            return self.decisions[step]
        return inputs.sparkSession.createDataFrame([], DECISIONS[step])


def shaped(df: DataFrame, step: str) -> DataFrame:
    """``df`` with exactly the columns of a step's decisions; those it lacks are null."""
    fields = df.sparkSession.createDataFrame([], DECISIONS[step]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def _first_line(size: int) -> Column:
    return F.substring(F.element_at(F.split("text", "\n"), 1), 1, size)


def _candidates(inputs: DataFrame) -> DataFrame:
    return inputs.select(
        "path", "segment", F.xxhash64("path", "segment").alias("index"), F.lit("fact").alias("kind"), _first_line(60).alias("summary"),
        F.substring("text", 1, 500).alias("content"), F.array().cast("array<string>").alias("keywords"), F.lit("agent_inferred").alias("origin"),
        F.lit(0.5).alias("confidence"),
    )


def _clusters(inputs: DataFrame) -> DataFrame:
    """A domain by kind, a chapter by the memories' own domain."""
    rows = inputs.withColumns({"domain": F.col("kind"), "sub": F.coalesce("domain", F.lit("general"))})
    members = rows.groupBy("domain", "sub").agg(F.collect_set("id").alias("member_ids"))
    return members.withColumns({"domain_place": F.xxhash64("domain"), "sub_place": F.xxhash64("sub")})


#: What a judge without a model decides. Every segment is worth reading and gives one memory of its first
#: line, all of them are kept and inserted, the listing's first rows are picked, windows are kept, nothing
#: is reorganised, chapters go by kind and domain, and texts are the beginnings of what they are about.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "triage": lambda rows: rows.withColumn("worth", F.lit(True)),
    "extract": _candidates,
    "verify": lambda rows: rows.select("index", F.lit("keep").alias("verdict")),
    "merge": lambda rows: rows.withColumn("action", F.lit("NEW")),
    "pick": lambda rows: rows.orderBy("id").limit(PICKED).select(F.col("id").alias("place"), "id"),
    "inbox-filter": lambda rows: rows.withColumn("keep", F.lit(True)),
    "reorganize": lambda rows: rows.where("false").select("id"),
    "synthesize-cluster": _clusters,
    "synthesize-theme": lambda rows: rows.select("theme", _first_line(60).alias("abstract"), F.substring("text", 1, 2000).alias("content")),
    "reply-gist": lambda rows: rows.select("topic_id", "reply_id", F.substring(squeeze(F.col("answer")), 1, 200).alias("gist")),
    "topic-summary": lambda rows: rows.select("topic_id", F.substring(squeeze(F.col("text")), 1, 200).alias("summary")),
    "store-card": lambda rows: rows.select("owner", "domain", F.concat(F.col("members").cast("string"), F.lit(" memories, such as: "), "sample").alias("card")),
    "audit": lambda rows: rows.select("id", F.lit("ok").alias("verdict")),
    "backfill": lambda rows: rows.select("id", F.split(F.coalesce("domain", F.lit("general")), " ").alias("keywords"), F.substring("summary", 1, 60).alias("mini")),
}


class RuleJudge:
    """A plain stand-in without a model, which follows ``RULES``."""

    def decide(self, step: str, inputs: DataFrame) -> DataFrame:
        return shaped(RULES[step](inputs), step)


def first_json(text: str | None) -> str | None:
    """The first complete JSON object or array in an answer, whatever stands around it."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(text or ""):
        if c in "{[":
            try:
                value, _ = decoder.raw_decode(text, i)
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None


@F.pandas_udf(StringType())
def _first_json(answers: pd.Series) -> pd.Series:
    return answers.map(first_json)


def rescued(answer: Column) -> Column:
    """The first complete JSON value in a model's answer, as compact text."""
    return _first_json(answer)


def parsed(answer: Column, ddl: str) -> Column:
    """A model's answer as a struct."""
    return F.from_json(rescued(answer), ddl)


def numeric_ids(ids: Column) -> Column:
    """Ids given as numbers or as strings of digits."""
    clean = F.transform(ids, lambda x: F.when(x.cast("string").rlike(r"^\d+$"), x.cast("string").cast("long")))
    return F.filter(clean, lambda x: x.isNotNull())
