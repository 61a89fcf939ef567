"""Slimming of dropped files and the states they go through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.text import clean
from anamnesis.operators.segments import WINDOW_CHARS
from anamnesis.sources.sessions import PART, PLUMBING

LEAST_CHARS = 50
USER_MARK, OTHER_MARK = "【用户】", "【AI】"
SPEAKERS = r"(?m)^(【用户】|【AI】|\s*(User|Human|Assistant|AI|用户|助手)\s*[:：])"


def slim_line(line: Column) -> Column:
    """One record as a spoken line, or null if it is none."""
    message = F.coalesce(F.get_json_object(line, "$.message"), line)
    kind = F.get_json_object(line, "$.type")
    role = F.coalesce(F.get_json_object(message, "$.role"), F.when(kind.isin("user", "assistant"), kind))
    content = F.get_json_object(message, "$.content")
    parts = F.filter(F.from_json(content, f"array<{PART}>"), lambda p: p["type"] == "text")
    listed = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    body = clean(F.coalesce(F.when(content.startswith("["), listed), content, F.lit("")))
    spoken = role.isin("user", "assistant") & (F.length(body) >= 2) & ~(body.startswith(PLUMBING[0]) | body.startswith(PLUMBING[1]))
    return F.when(spoken, F.concat(F.when(role == "user", USER_MARK).otherwise(OTHER_MARK), body))


def slimmed(entries: DataFrame) -> DataFrame:
    """``path, entry, format, text`` of entries that keep at least fifty characters."""
    lines = F.filter(F.transform(F.split("content", "\n"), slim_line), lambda x: x.isNotNull())
    text = F.when(F.col("format") == "session-jsonl", F.array_join(lines, "\n\n")).otherwise(clean(F.col("content")))
    return entries.select("path", "entry", "format", text.alias("text")).where(F.length("text") >= LEAST_CHARS)


def is_dialogue(text: Column) -> Column:
    return text.rlike(SPEAKERS)


def next_state(status: Column, same_hash: Column, dialogue: Column, lens: Column, through: Column, error: Column) -> Column:
    """A file's next state. ``through``: the filter reached its end; unknown verdicts keep a window."""
    return (
        F.when(~same_hash, "pending")
        .when(error.isNotNull(), "error")
        .when((status == "pending") & ~dialogue & ~lens, "skipped")
        .when((status == "skipped") & lens, "slimmed")
        .when(status == "pending", "slimmed")
        .when(status.isin("slimmed", "filtering") & through, "done")
        .when(status == "slimmed", "filtering")
        .otherwise(status)
    )


def registered(files: DataFrame, entries: DataFrame, at: Column, lenses: DataFrame | None = None) -> DataFrame:
    """``files`` after entries (of ``slimmed``) were looked at, each a state further, with ``text`` where there is
    one. A file is known by its path and entry; one that was dropped anew with another text starts again. One that
    was skipped is taken up when it gets a lens (``path, lens``: what to look for in it)."""
    seen = entries.select(
        F.concat_ws("!", "path", "entry").alias("path"), F.sha2("text", 256).alias("_hash"), F.col("format").alias("_format"),
        F.octet_length("text").cast("long").alias("_bytes"), F.length("text").cast("long").alias("_chars"), "text",
    )
    rows = files.join(seen, "path", "full")
    if lenses is not None:
        rows = rows.join(lenses.select("path", F.lit(True).alias("_lens")).distinct(), "path", "left")
    lensed = F.coalesce("_lens", F.lit(False)) if lenses is not None else F.lit(False)
    same = F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False))
    status = F.coalesce("status", F.lit("pending"))
    begun = F.when(same, status).otherwise("pending")
    moved = next_state(begun, F.lit(True), is_dialogue(F.col("text")), lensed, F.lit(False), F.lit(None).cast("string"))
    here = F.col("_hash").isNotNull()
    return rows.select(
        "id", "path", F.coalesce("_hash", "content_hash").alias("content_hash"), F.coalesce("_format", "format").alias("format"),
        F.coalesce("_bytes", "raw_bytes").alias("raw_bytes"), F.coalesce("_chars", "slim_chars").alias("slim_chars"),
        F.when(here, moved).otherwise(F.col("status")).alias("status"), F.when(same | ~here, F.col("lens_offsets")).alias("lens_offsets"),
        "filter_stats", "error", F.coalesce("created_at", at).alias("created_at"), F.when(here, at).otherwise(F.col("updated_at")).alias("updated_at"), "text",
    )


def advanced(files: DataFrame, taken: DataFrame, at: Column) -> DataFrame:
    """``files`` (of ``registered``) after a filter took windows up to ``through`` of a ``path`` by a ``lens``; when all
    its lenses are at the text's end it is done."""
    ends = taken.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("lens", F.col("through").cast("long")))).alias("_ends"))
    rows = files.join(ends, "path", "left")
    end = F.col("_ends").isNotNull()
    passed = F.transform_values("_ends", lambda _, through: F.least(through + WINDOW_CHARS, F.col("slim_chars")))
    kept = F.map_filter(F.coalesce("lens_offsets", F.create_map().cast("map<string,long>")), lambda lens, _: ~F.map_contains_key("_ends", lens))
    offsets = F.when(end, F.map_concat(kept, passed)).otherwise(F.col("lens_offsets"))
    reached = F.forall(F.map_values(offsets), lambda x: x >= F.col("slim_chars"))
    status = next_state(F.col("status"), F.lit(True), F.lit(True), F.lit(False), F.coalesce(reached, F.lit(False)), F.lit(None).cast("string"))
    moved = F.col("status").isin("slimmed", "filtering") & end
    return rows.withColumns({"lens_offsets": offsets, "status": F.when(moved, status).otherwise(F.col("status")), "updated_at": F.when(moved, at).otherwise(F.col("updated_at"))}).drop("_ends", "text")


def kept_windows(windows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that a filter keeps; without a verdict a window stays."""
    return windows.join(verdicts, keys, "left").where(F.coalesce("keep", F.lit(True))).drop("keep")
