"""Pushes of session lines from other machines, and the sessions that they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.operators.segments import fold_sorted, greedy_segments

AGENTS = ("claude-code", "pi", "codex")
NAME_CHARS = 200


def safe_path(name: Column, folders: bool = False) -> Column:
    """A relative name without tricks, or null."""
    bad = (
        (F.length(name) == 0) | (F.length(name) > NAME_CHARS) | name.contains("..") | name.startswith("/") | name.startswith("\\")
        | name.rlike("^[A-Za-z]:") | ~name.rlike(r"^[A-Za-z0-9._\-/\\]+$")
    )
    if not folders:
        bad |= name.contains("/") | name.contains("\\")
    return F.when(name.isNotNull() & ~bad, F.regexp_replace(name, r"^[./\\]+", ""))


def accepted(pushes: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pushes that go on where their session ends, and the others with where to go on.

    ``pushes``: ``machine, agent, uid, from_line, lines`` (and ``push``, their order); ``stored``: ``machine,
    uid, line_count``. In a batch a push may follow another one of its session.
    """
    have = F.coalesce("line_count", F.lit(0)).cast("long")
    rows = pushes.join(stored, ["machine", "uid"], "left").withColumn("have", have).drop("line_count")
    mine = Window.partitionBy("machine", "uid").orderBy("push").rowsBetween(Window.unboundedPreceding, -1)
    due = F.col("have") + F.coalesce(F.sum(F.size("lines")).over(mine), F.lit(0))
    rows = rows.withColumn("due", due)
    fits = (F.col("from_line") == F.col("due")) & F.col("agent").isin(*AGENTS) & (F.length("uid") > 0)
    broken = F.max((~F.coalesce(fits, F.lit(False))).cast("int")).over(Window.partitionBy("machine", "uid").orderBy("push"))
    rows = rows.withColumn("broken", broken)
    reason = F.when(~F.coalesce(F.col("agent").isin(*AGENTS), F.lit(False)), "unknown agent").when(F.coalesce(F.length("uid"), F.lit(0)) == 0, "no session id").otherwise("offset")
    good = rows.where("broken = 0").select(*pushes.columns)
    return good, rows.where("broken = 1").select("machine", "uid", "push", reason.alias("reason"), F.col("have").alias("expected"))


def landed_lines(pushes: DataFrame) -> DataFrame:
    """``machine, agent, uid, line_no, value``; line ends inside a line become spaces."""
    rows = pushes.select("machine", "agent", "uid", "from_line", F.posexplode("lines").alias("_i", "value"))
    return rows.select("machine", "agent", "uid", (F.col("from_line") + F.col("_i")).cast("long").alias("line_no"), F.regexp_replace("value", "\n", " ").alias("value"))


def session_state(lines: DataFrame) -> DataFrame:
    """Stored lines of each session of a machine."""
    return lines.groupBy("machine", "uid").agg(F.max("line_no").alias("_last")).select("machine", "uid", (F.col("_last") + 1).alias("line_count"))


def carried_over(incoming: DataFrame, registry: DataFrame, state: DataFrame) -> DataFrame:
    """``uid, path, processed``: where a session that is known by another path goes on.

    ``incoming``: ``uid, path, bytes``; ``registry``: ``uid, path``; ``state``: ``path, processed_bytes``.
    """
    known = registry.select("uid", F.col("path").alias("old_path")).join(state.select(F.col("path").alias("old_path"), "processed_bytes"), "old_path", "left")
    rows = incoming.join(known, "uid", "left")
    done = F.least(F.coalesce("processed_bytes", F.lit(0)), F.col("bytes"))
    return rows.select("uid", "path", F.when(F.col("old_path") != F.col("path"), done).otherwise(F.coalesce("processed_bytes", F.lit(0))).cast("long").alias("processed"))


def batches(lines: DataFrame, key: str, order: str, size: Column, most: int = 4 << 20) -> DataFrame:
    """Lines of a session in requests of about ``most`` bytes."""
    sized = lines.withColumn("_size", size)
    return greedy_segments(sized, key, order, "_size", most).withColumnRenamed("segment", "request")


def placed_bytes(pushes: DataFrame, stored: DataFrame) -> DataFrame:
    """``machine, uid, push, outcome, expected`` of pushes by byte offset.

    ``pushes``: ``push, machine, uid, offset, size, total``; ``stored``: ``machine, uid, bytes``. A push that
    begins where its session ends is ``stored``; one of a session that is complete is ``complete``; any
    other is told the offset that is expected. In a batch a push follows the earlier ones.
    """
    have = F.coalesce("bytes", F.lit(0)).cast("long").alias("have")
    rows = pushes.join(stored, ["machine", "uid"], "left").select("machine", "uid", "push", "offset", "size", "total", have)

    def step(at: int, p: dict) -> tuple[int, tuple]:
        if p["total"] is not None and at >= p["total"]:
            return at, ("complete", at)
        if p["offset"] != at:
            return at, ("offset", at)
        return at + p["size"], ("stored", at + p["size"])

    return fold_sorted(rows, ["machine", "uid"], ["push"], "outcome string, expected long", lambda p: p["have"], step)
