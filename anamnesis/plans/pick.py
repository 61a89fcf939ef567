"""Recall with a selector: the whole store as a pool, a judge's choice, the ledger, and the log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.deploy import durable
from anamnesis.functions.text import clip, handle, scrub, squeeze
from anamnesis.operators.selection import pool_in_order
from anamnesis.plans.judge import DECISIONS, Judge
from anamnesis.plans.recall import fast_recall
from anamnesis.schema import TABLES

POOL, PROBE_HINTS, PROBE_PROFILES, PROFILES = 300, 8, 5, 3
ABSTRACT_CHARS, LOGGED_CHARS = 120, 500


@dataclass
class Recalled:
    """Memories in order (with ``score`` and ``channel`` where they were ranked), chapters, and how many
    candidates the conversation had had."""

    memories: DataFrame
    profiles: DataFrame
    deduped: int


def chosen(pool: DataFrame, decisions: DataFrame, limit: int) -> DataFrame:
    """Rows of the pool in the order of the decisions; unknown ids fall away, repeated ones count once."""
    first = decisions.where("id IS NOT NULL").groupBy("id").agg(F.min("place").alias("place"))
    return pool.join(first, "id").orderBy("place", "id").limit(limit)


def chosen_profiles(profiles: DataFrame, decisions: DataFrame, owner: str, limit: int) -> DataFrame:
    """Active chapters in the order of the decisions, with their parent's title."""
    first = decisions.where("profile_id IS NOT NULL").groupBy(F.col("profile_id").alias("id")).agg(F.min("place").alias("place"))
    active = profiles.where((F.col("owner") == owner) & (F.col("status") == "active"))
    return with_parents(active.join(first, "id"), profiles).orderBy("place", "id").limit(limit)


def with_parents(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Chapters with ``shown``, the title after that of the parent, and ``gist``, the abstract or the
    beginning of the content."""
    parents = profiles.select(F.col("id").alias("_parent"), F.col("title").alias("parent_title"))
    joined = rows.join(parents, F.col("parent_id") == F.col("_parent"), "left").drop("_parent")
    gist = F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), clip(squeeze(F.col("content")), ABSTRACT_CHARS))
    return joined.withColumns({"shown": F.concat_ws(" / ", "parent_title", "title"), "gist": gist})


def selector_input(pool: DataFrame, directory: DataFrame, context: str | None, given: DataFrame | None) -> DataFrame:
    """What a selector reads: ``part`` (context, given, directory or listing), ``id`` and ``line``."""
    listing = pool.select(F.lit("listing").alias("part"), "id", F.concat(F.lit("[id "), F.col("id").cast("string"), F.lit("] ("), "kind", F.lit(") "), handle(F.col("mini"), F.col("summary"))).alias("line"))
    chapters = directory.select(F.lit("directory").alias("part"), "id", F.concat_ws(": ", "title", "gist").alias("line"))
    out = chapters.unionByName(listing)
    if given is not None:
        out = out.unionByName(given.select(F.lit("given").alias("part"), "id", F.col("summary").alias("line")))
    if context:
        row = pool.sparkSession.createDataFrame([("context", None, context)], "part string, id long, line string")
        out = out.unionByName(row)
    return out


def not_given(rows: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Rows that the ledger (``item`` as ``m:<id>``) hasn't."""
    if ledger is None:
        return rows
    item = F.concat(F.lit("m:"), F.col("id").cast("string"))
    return rows.withColumn("item", item).join(ledger.select("item"), "item", "left_anti").drop("item")


def deep_recall(memories: DataFrame, judge: Judge, query: str, as_of: Column, k: int = 5, owner: str = "default", scope: str = "all", cwd: str | None = None, ledger: DataFrame | None = None, profiles: DataFrame | None = None) -> Recalled:
    """The selector's choice among what the conversation hasn't had. If nothing is new, nothing is asked;
    if the selector fails, the fast ranking answers."""
    whole = durable(pool_in_order(memories, owner, scope, cwd, POOL))  # three hundred rows, used several times
    pool = not_given(whole, ledger)
    new = pool.count()
    deduped = whole.count() - new
    nothing = memories.sparkSession.createDataFrame([], DECISIONS["pick"])
    if profiles is None:
        profiles = memories.sparkSession.createDataFrame([], TABLES["profiles"])
    try:
        decisions = durable(judge.decide("pick", pool)) if new else nothing
    except (ConnectionError, TimeoutError):
        fast = fast_recall(memories, query, as_of, k, owner, scope, cwd, ledger=ledger)
        return Recalled(fast, chosen_profiles(profiles, nothing, owner, PROFILES), deduped)
    return Recalled(chosen(pool, decisions, min(k, 20)), chosen_profiles(profiles, decisions, owner, PROFILES), deduped)


def probe(memories: DataFrame, judge: Judge, owner: str = "default", scope: str = "all", cwd: str | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Pointers only, without the ledger: up to eight memories and five chapters, as ``what, id, kind, summary``."""
    pool = pool_in_order(memories, owner, scope, cwd, POOL)
    decisions = judge.decide("pick", pool)
    hints = chosen(pool, decisions, PROBE_HINTS).select(F.lit("memory").alias("what"), "id", "kind", "summary")
    if profiles is None:
        return hints
    more = chosen_profiles(profiles, decisions, owner, PROBE_PROFILES).select(F.lit("profile").alias("what"), "id", F.lit("profile").alias("kind"), F.col("shown").alias("summary"))
    return hints.unionByName(more)


def already_given(ledger: DataFrame, memories: DataFrame) -> DataFrame:
    """Summaries of what a conversation has had, as context for the selector: one row per conversation and item."""
    rows = ledger.where(F.col("item").startswith("m:")).withColumn("id", F.substring("item", 3, 20).cast("long"))
    return rows.join(memories.select("id", "summary"), "id").select("conversation", "id", "summary")


def recall_log(results: DataFrame, query: str, mode: str, at: Column, owner: str = "default", deduped: int = 0) -> DataFrame:
    """The log's row of one recall."""
    return results.agg(F.count("*").alias("hits")).select(
        at.alias("at"), F.lit(owner).alias("owner"), scrub(F.substring(F.lit(query), 1, LOGGED_CHARS)).alias("query"), F.lit(mode).alias("mode"), "hits",
        F.to_json(F.struct(F.lit(deduped).alias("deduped"))).alias("detail"),
    )


def latest_by_owner(rows: DataFrame) -> DataFrame:
    """The newest profile of each owner."""
    newest = Window.partitionBy("owner").orderBy(F.desc("updated_at"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


