"""Session logs as transcripts: one parser per agent, each from lines to formatted lines.

Lines come as ``path, line_no, value``. A record may give several transcript lines; ``part`` numbers
them. Lines that are no JSON give none, and an unknown agent's lines come back as errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import clip, strip, strip_envelope
from anamnesis.operators.ranking import running_sum
from anamnesis.operators.segments import capped

CALL_CHARS, RESULT_CHARS = 200, 300
PLUMBING = ("<command-", "<local-command")
PART = "struct<type:string,text:string,name:string,toolName:string,arguments:string,input:string,content:string>"
RECORD = f"struct<type:string,isMeta:boolean,cwd:string,sessionId:string,message:struct<role:string,content:string>>"


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """``path, line_no, value, start, size``: lines of the session files below ``path``, without those of
    sub-agents, with their numbers, the byte that each begins at, and the file's bytes.

    Files are split like any text, so a large one is read by many tasks; a file's lines are numbered in
    splits, and only the splits' counts are summed over a file. ``modified_after`` (a time, as of
    the last run) leaves files out without reading them. A last line without its line end is left
    for the next run.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value", (F.octet_length("value") + 1).alias("_bytes"),
    )
    rows = rows.where(~F.col("path").contains("/subagents/"))
    inside = Window.partitionBy("path", "_block").orderBy("_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_n": F.row_number().over(inside) - 1, "_at": F.coalesce(F.sum("_bytes").over(before), F.lit(0))})
    blocks = rows.groupBy("path", "_block").agg(F.count("*").alias("_lines"), F.sum("_bytes").alias("_sum"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "_block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_lines", "_sum")))
    rows = rows.join(blocks, ["path", "_block"])
    start = F.col("_sum_before") + F.col("_at")
    whole = rows.select("path", (F.col("_lines_before") + F.col("_n")).cast("int").alias("line_no"), "value", start.alias("start"), "size", "_bytes")
    return whole.where(F.col("start") + F.col("_bytes") <= F.col("size")).drop("_bytes")


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """``session, line_no, value`` of the files that ``sinks.write_sessions`` wrote, numbered within each session."""
    rows = read_lines(spark, folder, "*.txt")
    rows = rows.select(F.get_json_object("value", "$.session").alias("session"), "line_no", F.get_json_object("value", "$.value").alias("value"))
    return rows.withColumn("line_no", F.col("line_no") - F.min("line_no").over(Window.partitionBy("session")))


def _spoken(text: Column, role: Column) -> Column:
    body = strip(strip_envelope(text))
    return F.when(F.length(body) > 0, F.concat(F.lit("["), role, F.lit("] "), body))


def _part(part: Column, role: Column) -> Column:
    kind = part["type"]
    arguments = F.coalesce(part["arguments"], part["input"], F.lit("{}"))
    inner = F.from_json(part["content"], f"array<{PART}>")
    texts = F.array_join(F.transform(F.filter(inner, lambda p: (p["type"] == "text") & (F.length(p["text"]) > 0)), lambda p: p["text"]), "\n")
    body = strip(F.coalesce(F.when(part["content"].startswith("["), texts), part["content"], F.lit("")))
    return (
        F.when(kind == "text", _spoken(F.coalesce(part["text"], F.lit("")), role))
        .when(kind.isin("toolCall", "tool_call", "tool_use"), F.concat(F.lit("[tool call] "), F.coalesce(part["name"], part["toolName"], F.lit("tool")), F.lit(": "), clip(arguments, CALL_CHARS)))
        .when(kind.isin("toolResult", "tool_result") & (F.length(body) > 0), F.concat(F.lit("[tool result] "), clip(body, RESULT_CHARS)))
    )


def _formatted(rows: DataFrame, role: Column, plumbing: bool) -> DataFrame:
    content = F.col("r.message.content")
    listed = content.startswith("[")
    parts = F.transform(F.from_json(content, f"array<{PART}>"), lambda p: _part(p, role))
    spoken = _spoken(content, role)
    if plumbing:
        body = strip(strip_envelope(content))
        spoken = F.when(~(body.startswith(PLUMBING[0]) | body.startswith(PLUMBING[1])), spoken)
    lines = F.filter(F.when(listed, parts).otherwise(F.array(spoken)), lambda x: x.isNotNull())
    return rows.select("path", "line_no", F.posexplode(F.transform(lines, capped)).alias("part", "line"))


def parse_pi(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("r", F.from_json("value", RECORD)).where("r.type = 'message' AND r.message IS NOT NULL")
    return _formatted(rows, F.coalesce("r.message.role", F.lit("?")), False)


def parse_claude_code(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("r", F.from_json("value", RECORD))
    rows = rows.where("r.type IN ('user', 'assistant') AND NOT coalesce(r.isMeta, false) AND r.message IS NOT NULL")
    return _formatted(rows, F.coalesce("r.message.role", "r.type"), True)


def parse_text(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Lines as they are; of a file those that begin within its first ``most`` characters, if given."""
    rows = lines.select("path", "line_no", F.lit(0).alias("part"), capped(F.col("value")).alias("line"))
    if most is None:
        return rows
    sized = rows.withColumn("_size", F.length("line") + 1)
    return running_sum(sized, ["path"], ["line_no"], "_size", "_before").where(F.col("_before") < most).drop("_size", "_before")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"pi": parse_pi, "claude-code": parse_claude_code, "text": parse_text}


def parse(lines: DataFrame, agent: str = "agent") -> tuple[DataFrame, DataFrame]:
    """Transcript lines of all agents that have a parser, and ``path, error`` of the other files."""
    out = None
    for name, parser in PARSERS.items():
        mine = parser(lines.where(F.col(agent) == name))
        out = mine if out is None else out.unionByName(mine)
    unknown = lines.where(~F.coalesce(F.col(agent).isin(*PARSERS), F.lit(False)))
    errors = unknown.groupBy("path").agg(F.concat(F.lit("no parser for agent "), F.coalesce(F.first(agent), F.lit("?"))).alias("error"))
    return out, errors


def session_cwd(lines: DataFrame, head: int = 8192) -> DataFrame:
    """``path, cwd``: of the first record with one among the records in the first 8 KiB."""
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    through = F.sum(F.octet_length("value") + 1).over(before)
    rows = lines.withColumn("_through", through).where(F.col("_through") <= head)
    cwd = F.get_json_object("value", "$.cwd")
    return rows.groupBy("path").agg(F.min_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("cwd"))


def detect_agent(first_line: Column, name: Column) -> Column:
    """An agent by a file's first record and name; null if none fits."""
    kind, session = F.get_json_object(first_line, "$.type"), F.get_json_object(first_line, "$.sessionId")
    payload = F.get_json_object(first_line, "$.payload")
    return (
        F.when(name.startswith("rollout-") & ((kind == "session_meta") | payload.isNotNull()), "codex")
        .when(session.isNotNull(), "claude-code")
        .when((kind == "session") & F.get_json_object(first_line, "$.id").isNotNull(), "pi")
    )


def registered(registry: DataFrame, lines: DataFrame, at: Column) -> DataFrame:
    """The registry after files were read (``path, line_no, value, agent``): a row for each session, at the
    path it was seen at last."""
    first = lines.where("line_no = 0").select("path", "agent", F.col("value").alias("_first"))
    size = lines.groupBy("path").agg((F.max("size") if "size" in lines.columns else F.sum(F.octet_length("value") + 1)).cast("long").alias("bytes"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[A-Za-z]+)?$", 1)
    uid = session_uid(F.col("agent"), F.col("_first"), stem, F.col("_first")).alias("session_uid")
    seen = first.join(size, "path").select(uid, "agent", F.lit(None).cast("string").alias("machine"), "path", "bytes", at.alias("updated_at"))
    seen = seen.groupBy("session_uid").agg(F.max_by(F.struct("agent", "machine", "path", "bytes", "updated_at"), F.struct("bytes", "path")).alias("s")).select("session_uid", "s.*")
    known = registry.select("session_uid", F.col("machine").alias("_machine"))
    seen = seen.join(known, "session_uid", "left").withColumn("machine", F.coalesce("machine", "_machine"))
    return registry.join(seen, "session_uid", "left_anti").unionByName(seen.select(*registry.columns))


def session_uid(agent: Column, first_line: Column, stem: Column, head: Column) -> Column:
    """A session's identity wherever it comes from: its own id, else a long file name, else a hash of
    its first 4096 bytes."""
    own = F.get_json_object(first_line, "$.sessionId")
    return F.coalesce(
        F.when((agent == "claude-code") & (F.length(own) >= 8), own),
        F.when(F.length(stem) >= 12, stem),
        F.substring(F.sha2(F.substring(head, 1, 4096), 256), 1, 32),
    )
