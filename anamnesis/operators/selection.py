"""Filters, listings and lookups over memories and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.text import clip
from anamnesis.operators.ranking import numbered
from anamnesis.schema import PERSONAL_KINDS

LISTED = ("id", "kind", "summary", "pinned", "last_seen")


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(value, most))


def clamped(value: Column, least: int, most: int, default: int) -> Column:
    """A count as it is asked for: the default if it is missing, and within its limits."""
    return F.greatest(F.lit(least), F.least(F.coalesce(value, F.lit(default)), F.lit(most)))


def in_scope(scope: str, cwd: str | None) -> Column:
    """``all`` (or no directory): everything; ``cwd``: this directory or none; ``smart``: also what is
    personal."""
    if scope == "all" or not cwd:
        return F.lit(True)
    here = (F.col("cwd") == cwd) | F.col("cwd").isNull()
    return here if scope == "cwd" else here | F.col("kind").isin(*PERSONAL_KINDS)


def owned(memories: DataFrame, owner: str = "default", statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    return memories.where((F.col("owner") == owner) & F.col("status").isin(*statuses))


def list_memories(memories: DataFrame, owner: str = "default", status: str = "active", limit: int = 100) -> DataFrame:
    """Pinned first, then the last seen; ties by id."""
    return owned(memories, owner, (status,)).orderBy(F.desc("pinned"), F.desc("last_seen"), "id").limit(limit)


def merge_candidates(memories: DataFrame, as_of: Column, days: int, owner: str = "default") -> DataFrame:
    """Active memories that are pinned, well supported or seen in the last ``days``."""
    since = F.date_sub(as_of, days)
    return owned(memories, owner).where((F.col("pinned") == 1) | (F.col("evidence") >= 3) | (F.col("last_seen") >= since))


def by_ids(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """Active memories that are asked for (``id, position``), with ``place``, 1, 2, ... in the order of positions; of an
    id that is named twice, the last position counts."""
    last = asked.groupBy("id").agg(F.max("position").alias("position"))
    rows = memories.where("status = 'active'").join(last, "id")
    return numbered(rows, "position", "id").withColumnRenamed("number", "place").drop("position")


def constitution(memories: DataFrame, owner: str, scope: str = "all", cwd: str | None = None, limit: int = 5) -> DataFrame:
    """Pinned memories with the most confidence, then evidence; ties by id."""
    rows = owned(memories, owner).where(F.col("pinned") == 1).where(in_scope(scope, cwd))
    return rows.orderBy(F.desc("confidence"), F.desc("evidence"), "id").limit(limit)


def profile_directory(profiles: DataFrame, owner: str) -> DataFrame:
    """Active profiles, newest first; short roots show their content."""
    root = F.col("parent_id").isNull() & (F.length("content") > 0) & (F.length("content") <= 200)
    rows = profiles.where((F.col("owner") == owner) & (F.col("status") == "active"))
    return rows.orderBy(F.desc("updated_at"), "id").select(
        "id", "title", "maturity", "parent_id", F.when(root, F.col("content")).alias("gist")
    )


def counts_by_status(memories: DataFrame, owner: str | None = None) -> DataFrame:
    rows = memories if owner is None else memories.where(F.col("owner") == owner)
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def fresh_strip(memories: DataFrame, owner: str, built: Column, limit: int = 8) -> DataFrame:
    """The newest memories since a card was built."""
    rows = owned(memories, owner).where(F.col("created_at") > built)
    return rows.orderBy(F.desc("id")).limit(limit).select("id", clip(F.col("summary"), 50).alias("summary"))


def pool_in_order(memories: DataFrame, owner: str, scope: str, cwd: str | None, cap: int = 300) -> DataFrame:
    """The whole store as a selector's pool: oldest ids first, so a prompt's beginning stays the same."""
    return owned(memories, owner).where(in_scope(scope, cwd)).orderBy("id").limit(cap)


def profiles_newest_first(profiles: DataFrame, owner: str, status: str = "active") -> DataFrame:
    rows = profiles.where((F.col("owner") == owner) & (F.col("status") == status))
    return rows.orderBy(F.desc("updated_at"), "id")


def owners(memories: DataFrame) -> DataFrame:
    return memories.select("owner").distinct()


def material(memories: DataFrame, owner: str, each: int = 2000) -> DataFrame:
    """What chapters are made of: active rows and absorbed ones, the last seen of each."""
    newest = lambda status: owned(memories, owner, (status,)).orderBy(F.desc("last_seen"), "id").limit(each)
    return newest("active").unionByName(newest("absorbed"))


def wanted(demands: DataFrame, owner: str, limit: int = 10) -> DataFrame:
    """The domains most asked for."""
    rows = demands.where(F.col("owner") == owner)
    return rows.orderBy(F.desc("demand_count"), F.desc("last_demand_at"), "domain").limit(limit)
