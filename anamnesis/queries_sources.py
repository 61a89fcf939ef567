"""Driver queries of sources, sinks, and the functions around them, each with its SQL."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import functions as F

from anamnesis import fixtures as X
from anamnesis.deploy import shared_folder
from anamnesis.functions import text as T
from anamnesis.operators import segments as G
from anamnesis.operators import selection as S
from anamnesis.operators import upkeep as U
from anamnesis.plans import judge as J
from anamnesis.plans import pick as P
from anamnesis.queries import MEM, ORACLES, OWN, REQ, as_of, in_order, query
from anamnesis.snapshots import SnapshotStore
from anamnesis.sources import archives as A
from anamnesis.sources import inbox as I
from anamnesis.sources import records as Q
from anamnesis.sources import sessions as E
from anamnesis.sources import sinks as K
from anamnesis.sources import sync as Y

BLANK = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]+"
STRIPPED = rf"regexp_replace(text, '^{BLANK}|{BLANK}$', '', 'g')"
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations"


def scratch(spark, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def message(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def clipped_sql(text: str, size: int) -> str:
    return f"CASE WHEN length({text}) > {size} THEN substr({text}, 1, {size}) || '…' ELSE {text} END"


# ---- session files ---------------------------------------------------------------------------

@query(f"SELECT conv_id, n AS line_no, text FROM ({NUMBERED})")
def session_lines(spark, sf):
    """Sessions written as files and read back by splits, with the numbers of lines."""
    rows = X.table(spark, sf, "conversations")
    folder = scratch(spark, "sessions")
    K.write_sessions(rows.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), message(text=F.col("text")).alias("value")), folder)
    out = E.read_sessions(spark, folder)
    return out.select(F.col("session").cast("long").alias("conv_id"), F.col("line_no").cast("long").alias("line_no"), F.get_json_object("value", "$.text").alias("text"))


@query(rf"""SELECT conv_id, turn, '[' || role || '] ' || {STRIPPED} AS line FROM conversations
    WHERE role IN ('user', 'assistant') AND turn % 7 <> 3 AND conv_id % 5 <> 0 AND length({STRIPPED}) > 0""")
def claude_transcripts(spark, sf):
    body = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("<command-name>"), "text")).otherwise(F.col("text"))
    record = message(type=F.col("role"), isMeta=F.col("turn") % 7 == 3, message=F.struct("role", body.alias("content")))
    rows = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), record.alias("value"))
    return E.parse_claude_code(rows).select(F.col("path").alias("conv_id"), F.col("line_no").alias("turn"), "line")


LINES = "SELECT doc_id, CAST(i AS BIGINT) AS line_no, ls[i + 1] AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(len(ls))) AS i)"


def _lines(spark, sf):
    rows = X.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value"))
    return rows.withColumn("line_no", F.col("line_no").cast("long"))


@query(f"""WITH c AS (SELECT doc_id, line_no, CASE WHEN length(value) > 8192 THEN substr(value, 1, 8192) || '…' ELSE value END AS line FROM ({LINES})),
        r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS before FROM c)
    SELECT doc_id, line_no, line FROM r WHERE before < 5000""")
def text_transcripts(spark, sf):
    return E.parse_text(_lines(spark, sf), 5000).select(F.col("path").alias("doc_id"), "line_no", "line")


@query("SELECT doc_id, CASE WHEN length(text) > 8192 THEN substr(text, 1, 8192) || '…' ELSE text END AS line FROM documents")
def capped_lines(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", G.capped(F.col("text")).alias("line"))


@query(rf"""SELECT conv_id, turn, CASE conv_id % 4 WHEN 2 THEN text ELSE '[' || role || '] ' || {STRIPPED} END AS line, '' AS error FROM conversations
    WHERE conv_id % 4 < 3 AND (conv_id % 4 = 2 OR length({STRIPPED}) > 0) AND (conv_id % 4 <> 1 OR role IN ('user', 'assistant'))
    UNION ALL SELECT DISTINCT conv_id, NULL, NULL, 'no parser for agent codex' FROM conversations WHERE conv_id % 4 = 3""")
def parsed_by_agent(spark, sf):
    agent = F.element_at(F.array(*map(F.lit, ("pi", "claude-code", "text", "codex"))), (F.col("conv_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("conv_id") % 4 == 1, F.col("role")).otherwise("message")
    record = message(type=kind, message=F.struct("role", F.col("text").alias("content")))
    value = F.when(F.col("conv_id") % 4 == 2, F.col("text")).otherwise(record)
    rows = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), value.alias("value"), agent.alias("agent"))
    out, errors = E.parse(rows)
    good = out.select(F.col("path").alias("conv_id"), F.col("line_no").alias("turn"), "line", F.lit("").alias("error"))
    return good.unionByName(errors.select(F.col("path").alias("conv_id"), F.lit(None).cast(good.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("line"), "error"))


ARGS = """('{"command":' || CAST(to_json(text) AS VARCHAR) || '}')"""


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, {STRIPPED} AS body FROM conversations)
    SELECT conv_id, turn, '[' || role || '] ' || body AS line FROM c WHERE length(body) > 0
    UNION ALL SELECT conv_id, turn, '[tool call] run: ' || {clipped_sql(ARGS, 200)} FROM c
    UNION ALL SELECT conv_id, turn, '[tool result] ' || {clipped_sql('body', 300)} FROM c WHERE length(body) > 0""")
def formatted_parts(spark, sf):
    """Texts, thoughts (which go), calls and results of one record."""
    text, none = F.col("text"), F.lit(None).cast("string")
    part = lambda kind, **values: F.struct(F.lit(kind).alias("type"), *(values.get(k, none).alias(k) for k in ("text", "name", "content")), values.get("arguments", F.struct(none.alias("command"))).alias("arguments"))
    parts = F.array(part("text", text=text), part("thinking", text=text), part("toolCall", name=F.lit("run"), arguments=F.struct(text.alias("command"))), part("toolResult", content=text))
    record = message(type=F.lit("message"), message=F.struct("role", parts.alias("content")))
    rows = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), record.alias("value"))
    return E.parse_pi(rows).select(F.col("path").alias("conv_id"), F.col("line_no").alias("turn"), "line")


@query("""WITH v AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 4 THEN '{"cwd":"/w/' || conv_id || '/' || turn || '"}' ELSE '{"x":"' || repeat('a', 20 * length(text)) || '"}' END AS value FROM conversations),
        t AS (SELECT *, sum(length(value) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS through FROM v)
    SELECT conv_id, arg_min(json_extract_string(value, '$.cwd'), turn) FILTER (through <= 8192 AND value LIKE '{"cwd%') AS cwd FROM t GROUP BY conv_id HAVING min(through) <= 8192""")
def session_dirs(spark, sf):
    there = F.concat(F.lit('{"cwd":"/w/'), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit('"}'))
    other = F.concat(F.lit('{"x":"'), F.repeat(F.lit("a"), F.length("text") * 20), F.lit('"}'))
    rows = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, there).otherwise(other).alias("value"))
    return E.session_cwd(rows).select(F.col("path").alias("conv_id"), "cwd")


@query("""WITH l AS (SELECT conv_id, n, CASE WHEN n = 0 AND conv_id % 2 = 0 THEN '{"sessionId":"session-' || conv_id || '"}' ELSE '{"x":' || n || '}' END AS value FROM (""" + NUMBERED + """))
    SELECT CASE WHEN conv_id % 2 = 0 THEN 'session-' || conv_id ELSE 'long-file-name-' || conv_id END AS session_uid, 'dir/long-file-name-' || conv_id || '.jsonl' AS path,
        CAST(sum(length(value) + 1) AS BIGINT) AS bytes, CASE WHEN conv_id % 3 = 0 THEN 'm1' END AS machine FROM l GROUP BY conv_id""")
def session_registry(spark, sf):
    """What the registry holds after sessions were seen, of which it knew a third by other paths."""
    rows = X.table(spark, sf, "conversations").withColumn("line_no", F.row_number().over(_by_turn()) - 1)
    own = F.col("conv_id").cast("string")
    first = F.concat(F.lit('{"sessionId":"session-'), own, F.lit('"}'))
    value = F.when((F.col("line_no") == 0) & (F.col("conv_id") % 2 == 0), first).otherwise(F.concat(F.lit('{"x":'), F.col("line_no").cast("string"), F.lit("}")))
    lines = rows.select(F.concat(F.lit("dir/long-file-name-"), own, F.lit(".jsonl")).alias("path"), "line_no", value.alias("value"), F.when(F.col("conv_id") % 2 == 0, "claude-code").otherwise("pi").alias("agent"))
    uid = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("session-"), own)).otherwise(F.concat(F.lit("long-file-name-"), own))
    known = rows.where("conv_id % 3 = 0").select(uid.alias("session_uid"), F.lit("pi").alias("agent"), F.lit("m1").alias("machine"), F.lit("old").alias("path"), F.lit(1).cast("long").alias("bytes"), as_of().cast("timestamp").alias("updated_at")).distinct()
    return E.registered(known, lines, as_of().cast("timestamp")).select("session_uid", "path", "bytes", "machine")


def _by_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


# ---- dropped files ---------------------------------------------------------------------------

@query("""WITH d AS (SELECT doc_id, CAST(floor(doc_id / 10) AS BIGINT) AS f, text, min(doc_id) OVER (PARTITION BY floor(doc_id / 10)) AS first FROM documents)
    SELECT 'drops/f' || f || CASE WHEN f % 3 = 2 THEN '' ELSE '.pack' END AS path, CASE WHEN f % 3 = 2 THEN 'f' || f ELSE 'd' || doc_id || '.md' END AS entry, md5(text) AS digest
    FROM d WHERE CASE WHEN f % 3 = 2 THEN doc_id = first ELSE doc_id % 4 <> 3 END""")
def archive_entries(spark, sf):
    """Zip files, tar.gz files and plain ones, routed by their first bytes; names of other kinds go."""
    out = A.unpack(X.archives(spark, sf))
    return out.select("path", "entry", F.md5(F.col("content").cast("binary")).alias("digest"))


CALL = """'{"type":"message","message":{"role":"user"}}'"""


@query(f"""SELECT doc_id, doc_id % 3 < 2 AND len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0)) <= 50 AND length(text) + 1 + length(m) <= 65536 AS is_session
    FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN {CALL} ELSE replace({CALL}, '"type":"message"', '"parentUuid":"x"') END AS m FROM documents)""")
def session_sniffer(spark, sf):
    """A message after a document's lines, among the first ones or too late, and texts without one."""
    call = '{"type":"message","message":{"role":"user"}}'
    line = F.when(F.col("doc_id") % 3 == 0, call).when(F.col("doc_id") % 3 == 1, call.replace('"type":"message"', '"parentUuid":"x"')).otherwise("the end")
    return X.table(spark, sf, "documents").select("doc_id", A.is_session(F.concat("text", F.lit("\n"), line)).alias("is_session"))


@query("""SELECT doc_id, substr(sha256(encode(octet_length(encode(text)) || '|' || doc_id * 1000) || encode(left(a, 65536)) || encode(right(a, 65536))), 1, 16) AS fingerprint
    FROM (SELECT doc_id, text, regexp_replace(text, '[^ -~]', '?', 'g') AS a FROM documents)""")
def file_fingerprints(spark, sf):
    content = F.regexp_replace("text", "[^ -~]", "?").cast("binary")
    return X.table(spark, sf, "documents").select("doc_id", A.fingerprint(F.octet_length("text"), F.col("doc_id") * 1000, content).alias("fingerprint"))


@query(f"""SELECT doc_id, regexp_matches(text, '(?m)^(【用户】|【AI】|{BLANK}*(User|Human|Assistant|AI|用户|助手){BLANK}*[:：])') OR doc_id % 4 = 0 AS talk FROM documents""".replace("]+*", "]*"))
def dialogue_guard(spark, sf):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n Assistant : yes"))).otherwise(F.col("text"))
    return X.table(spark, sf, "documents").select("doc_id", I.is_dialogue(text).alias("talk"))


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS k, length('User: ' || text) AS n, doc_id % 2 = 0 AS talk FROM documents),
        s AS (SELECT doc_id, CASE WHEN k = 0 THEN CASE WHEN talk THEN 'slimmed' ELSE 'skipped' END WHEN k = 1 THEN 'filtering' ELSE CASE WHEN talk THEN 'slimmed' ELSE 'skipped' END END AS status, n, k FROM d WHERE n >= 50)
    SELECT 'f' || doc_id || '!x.md' AS path, CASE WHEN status IN ('slimmed', 'filtering') THEN 'done' ELSE status END AS status,
        CASE WHEN status IN ('slimmed', 'filtering') THEN n END AS through FROM s""")
def inbox_run(spark, sf):
    """Files that are new, known, or dropped again with another text, looked at once and filtered to the end."""
    docs = X.table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("User: "), "text")).otherwise(F.concat(F.lit("Uses: "), "text"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    entries = docs.select(name.alias("path"), F.lit("x.md").alias("entry"), F.lit("text").alias("format"), text.alias("text")).where(F.length("text") >= 50)
    at = as_of().cast("timestamp")
    hashed = F.when(F.col("doc_id") % 3 == 1, F.sha2(text, 256)).otherwise("other")
    blank = {c: F.lit(None).cast(t) for c, t in (("lens_offsets", "map<string,long>"), ("filter_stats", "map<string,long>"), ("error", "string"))}
    known = docs.where("doc_id % 3 > 0").where(F.length(text) >= 50).select(
        F.col("doc_id").alias("id"), F.concat(name, F.lit("!x.md")).alias("path"), hashed.alias("content_hash"), F.lit("text").alias("format"), F.lit(1).cast("long").alias("raw_bytes"),
        F.lit(1).cast("long").alias("slim_chars"), F.when(F.col("doc_id") % 3 == 1, "filtering").otherwise("done").alias("status"), at.alias("created_at"), at.alias("updated_at"),
    ).withColumns(blank)
    seen = I.registered(known, entries, at)
    open_ = seen.where(F.col("status").isin("slimmed", "filtering"))
    taken = open_.select("path", F.lit("default").alias("lens"), (F.floor((F.length("text") - 1) / G.WINDOW_CHARS) * G.WINDOW_CHARS).alias("through"))
    out = I.advanced(seen, taken, at)
    return out.select("path", "status", F.col("lens_offsets")["default"].alias("through"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 7 AS segment, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'late', doc_id, text FROM documents WHERE doc_id % 5 = 0")
def kept_text(spark, sf):
    """Two runs' kept windows in one folder."""
    rows, folder = X.table(spark, sf, "documents"), scratch(spark, "kept")
    K.append_kept(rows.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 7).alias("segment"), "text"), folder)
    K.append_kept(rows.where("doc_id % 5 = 0").select(F.lit("late").alias("path"), F.col("doc_id").alias("segment"), "text"), folder)
    return spark.read.schema("path string, segment long, text string").json(folder)


# ---- pushes ----------------------------------------------------------------------------------

@query("""WITH p AS (SELECT event_id AS push, user_id AS uid, event_id % 3 AS n, user_id % 2 * 4 AS have,
            sum(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) - event_id % 3 AS plain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
        f AS (SELECT *, max(CASE WHEN k = 3 + uid % 40 OR uid % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY push) AS broken FROM p)
    SELECT uid, push, CAST(plain + have + i AS BIGINT) AS line_no, 'line ' || i AS value, '' AS reason FROM f, LATERAL (SELECT unnest(range(n)) AS i) WHERE broken = 0
    UNION ALL SELECT uid, push, have, NULL, CASE WHEN uid % 11 = 0 THEN 'unknown agent' ELSE 'offset' END FROM f WHERE broken = 1""")
def line_pushes(spark, sf):
    """Lines that land, and for the pushes that don't the place to go on from."""
    from pyspark.sql import Window

    mine = Window.partitionBy("user_id").orderBy("event_id")
    n = (F.col("event_id") % 3).cast("int")
    rows = X.table(spark, sf, "events").withColumns({"n": n, "k": F.row_number().over(mine), "plain": F.sum(n).over(mine) - n})
    begin = F.col("plain") + F.col("user_id") % 2 * 4 + F.when(F.col("k") == 3 + F.col("user_id") % 40, 1).otherwise(0)
    pushes = rows.select(
        F.col("event_id").alias("push"), F.lit("m").alias("machine"), F.when(F.col("user_id") % 11 == 0, "nobody").otherwise("pi").alias("agent"), F.col("user_id").cast("string").alias("uid"),
        begin.alias("from_line"), F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), F.col("n")), lambda i: F.concat(F.lit("line\n"), i.cast("string"))).alias("lines"),
    )
    stored = pushes.select("machine", "uid").distinct().withColumn("line_count", (F.col("uid").cast("long") % 2 * 4).cast("long"))
    good, bad = Y.accepted(pushes, stored)
    lines = Y.landed_lines(good.withColumn("uid", F.concat_ws(":", "uid", F.col("push").cast("string"))))
    split = F.split("uid", ":")
    landed = lines.select(split[0].cast("long").alias("uid"), split[1].cast("long").alias("push"), "line_no", "value", F.lit("").alias("reason"))
    return landed.unionByName(bad.select(F.col("uid").cast("long").alias("uid"), "push", F.col("expected").alias("line_no"), F.lit(None).cast("string").alias("value"), "reason"))


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    , f AS (SELECT source, doc_id, n, 0 AS request, CASE WHEN s + 1 >= 20000 THEN 0 ELSE s + 1 END AS used, CASE WHEN s + 1 >= 20000 THEN 1 ELSE 0 END AS full FROM r WHERE n = 1
        UNION ALL SELECT r.source, r.doc_id, r.n, f.request + f.full, CASE WHEN f.used + s + 1 >= 20000 THEN 0 ELSE f.used + s + 1 END,
            CASE WHEN f.used + s + 1 >= 20000 THEN 1 ELSE 0 END FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1)
    SELECT source, doc_id, CAST(request AS BIGINT) AS request FROM f""")
def push_batches(spark, sf):
    return Y.batches(X.table(spark, sf, "documents"), "source", "doc_id", F.col("n_chars"), 20_000)


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude-code' WHEN 2 THEN 'pi' WHEN 3 THEN 'codex' END AS agent FROM pages""")
def detected_agents(spark, sf):
    n, own = F.col("page_id"), F.col("page_id").cast("string")
    first = F.element_at(F.array(*map(F.lit, ('{"type":"session_meta"}', '{"sessionId":"s-1"}', '{"type":"session","id":"x"}', '{"payload":{"a":1}}', '{"type":"message"}'))), (n % 5 + 1).cast("int"))
    name = F.concat(F.when(n % 5 == 4, "notes-").otherwise("rollout-"), own)
    return X.table(spark, sf, "pages").select("page_id", E.detect_agent(first, name).alias("agent"))


# ---- records ---------------------------------------------------------------------------------

JSONTEXT = "CAST(to_json({}) AS VARCHAR)"
LONGTEXT = "repeat(text, 1 + CAST(120000 / (length(text) + 1) AS BIGINT))"


@query(f"""SELECT doc_id, '{{"type":"assistant","message":{{"role":"assistant","content":[{{"type":"text","text":' || {JSONTEXT.format('text')} || '}},{{"type":"thinking","stripped":true}},{{"type":"tool_use","name":"run","input":{{"command":'
        || {JSONTEXT.format('substr(text, 1, 300)')} || '}}}},{{"type":"tool_result","content":' || {JSONTEXT.format('substr(text, 1, 500)')} || ',"truncated":' || (length(text) > 500) || '}}]}}}}' AS slim FROM documents WHERE n_chars <= 50000""")
def slimmed_records(spark, sf):
    """Texts stay, thoughts go, calls and results are cut."""
    text, none = F.col("text"), F.lit(None).cast("string")
    names = ("text", "thinking", "name", "content")
    part = lambda kind, given=None, **values: F.struct(F.lit(kind).alias("type"), *(values.get(k, none).alias(k) for k in names), (given if given is not None else F.lit(None).cast("struct<command:string>")).alias("input"))
    parts = F.array(part("text", text=text), part("thinking", thinking=text), part("tool_use", F.struct(text.alias("command")), name=F.lit("run")), part("tool_result", content=text))
    record = message(type=F.lit("assistant"), message=F.struct(F.lit("assistant").alias("role"), parts.alias("content")))
    return X.table(spark, sf, "documents").where("n_chars <= 50000").select("doc_id", Q.slimmed_record(record, F.lit("pi")).alias("slim"))


@query(f"""SELECT doc_id, '{{"note":' || {JSONTEXT.format("substr(t, 1, 25000) || chr(10) || '…[' || (length(t) - 50000) || ' chars dropped]…' || chr(10) || right(t, 25000)")} || ',"n":' || doc_id || '}}' AS slim
    FROM (SELECT doc_id, {LONGTEXT} AS t FROM documents WHERE length(text) > 0) WHERE length(t) > 50000""")
def long_records(spark, sf):
    """Texts over 50,000 characters keep their ends."""
    rows = X.table(spark, sf, "documents").where(F.length("text") > 0)
    long_ = rows.select("doc_id", F.expr("repeat(text, 1 + cast(rint(120000 / (length(text) + 1)) as int))").alias("t")).where(F.length("t") > 50_000)
    return long_.select("doc_id", Q.slimmed_record(message(note=F.col("t"), n=F.col("doc_id")), F.lit("pi")).alias("slim"))


@query("""WITH r AS (SELECT doc_id, regexp_replace(text, '[^ !#-\\[\\]-~]', '?', 'g') AS t, length('{"note":"","n":' || doc_id || '}') AS frame FROM documents)
    SELECT doc_id, '{"note":"' || CASE WHEN length(t) + frame > 3000 THEN substr(t, 1, 3000 - frame - 12) || '…[truncated]' ELSE t END || '","n":' || doc_id || '}' AS slim FROM r""".replace("\\\\", "\\"))
def capped_records(spark, sf):
    """Records over a size have their texts cut until they fit."""
    plain = F.regexp_replace("text", r"[^ !#-\[\]-~]", "?")
    rows = X.table(spark, sf, "documents").select("doc_id", message(note=plain, n=F.col("doc_id")).alias("line"))
    return rows.select("doc_id", Q.slimmed_record(F.col("line"), F.lit("pi"), 3000).alias("slim"))


# ---- functions and small operators -----------------------------------------------------------

@query("WITH g AS (" + ORACLES["greedy_segments"] + """), t AS (SELECT g.conv_id, segment, string_agg(text, chr(10) ORDER BY c.turn) AS text, max(c.turn) AS through FROM g JOIN conversations c ON c.conv_id = g.conv_id AND c.turn = g.turn GROUP BY 1, 2)
    SELECT conv_id, segment, md5(text) AS digest, through, length(text) < 300 AS skipped FROM t""")
def segment_skips(spark, sf):
    """Segments under 300 characters only move the offset."""
    lines = X.table(spark, sf, "conversations").withColumn("size", F.length("text"))
    out = G.segment_texts(lines, G.greedy_segments(lines, "conv_id", "turn", "size", 900), "conv_id", "turn", "text", 300)
    return out.select("conv_id", "segment", F.md5(F.col("text").cast("binary")).alias("digest"), "through", "skipped")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN greatest(0, n_chars - 1000) WHEN n_chars < doc_id * 5 THEN 0 ELSE doc_id * 5 END AS start FROM documents""")
def resume_offsets(spark, sf):
    done = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 5)
    return X.table(spark, sf, "documents").select("doc_id", G.resume_at(F.col("n_chars").cast("long"), done, 1000).alias("start"))


@query("SELECT event_id, greatest(1, least(coalesce(nullif(event_id % 40 - 5, 0), 5), 20)) AS k, greatest(1, least(coalesce(event_id % 200 - 10, 7), 90)) AS days FROM events")
def clamped_counts(spark, sf):
    n = F.col("event_id")
    k = S.clamped(F.nullif(n % 40 - 5, F.lit(0).cast("long")), 1, 20, 5)
    return X.table(spark, sf, "events").select("event_id", k.cast("long").alias("k"), S.clamped(n % 200 - 10, 1, 90, 7).cast("long").alias("days"))


@query("SELECT doc_id, array_to_string(list_filter([doc_id, 7, doc_id + 1, 5], lambda x, i: list_position([doc_id, 7, doc_id + 1, 5], x) = i), ',') AS members FROM documents")
def joined_member_ids(spark, sf):
    old, new = F.when(F.col("doc_id") >= 0, F.array("doc_id", F.lit(7).cast("long"))), F.array(F.col("doc_id") + 1, F.lit(7).cast("long"), F.lit(5).cast("long"), "doc_id")
    return X.table(spark, sf, "documents").select("doc_id", F.array_join(U.joined_members(old, new).cast("array<string>"), ",").alias("members"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '{{"worth":true,"reason":' || {JSONTEXT.format('text')} || ',"n":[1,' || doc_id || ']}}' END AS answer FROM documents""")
def json_rescue(spark, sf):
    """Answers in fences and among prose, with brackets in strings, and ones that break off."""
    body = message(worth=F.lit(True), reason=F.col("text"), n=F.array(F.lit(1).cast("long"), "doc_id"))
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{ "), F.substring(body, 2, 20))).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure } here:\n```json\n"), body, F.lit("\n``` and { more"))).otherwise(body)
    return X.table(spark, sf, "documents").select("doc_id", J.rescued(said).alias("answer"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '7' ELSE doc_id || ',7' END AS ids FROM documents")
def coerced_ids(spark, sf):
    own = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return X.table(spark, sf, "documents").select("doc_id", F.array_join(J.numeric_ids(F.array(own, F.lit("1.5"), F.lit("7"), F.lit("-2"))).cast("array<string>"), ",").alias("ids"))


# ---- profiles and demands --------------------------------------------------------------------

PRO = """WITH pro AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'team' ELSE 'default' END AS owner, s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey - s_suppkey % 3 END AS parent_id,
    CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name ELSE '' END AS abstract, repeat('text of ' || s_name || chr(10), CAST(s_suppkey % 9 AS BIGINT)) AS content, CASE WHEN s_suppkey % 7 = 0 THEN 'archived' ELSE 'active' END AS status,
    (s_suppkey * 13) % 29 AS day, CASE WHEN s_suppkey % 4 = 0 THEN 'seeding' ELSE 'mature' END AS maturity FROM supplier)"""


def _profiles(spark, sf):
    key, name = F.col("s_suppkey"), F.col("s_name")
    return X.table(spark, sf, "supplier").select(
        key.alias("id"), F.when(key % 5 == 0, "team").otherwise("default").alias("owner"), name.alias("title"), F.when(key % 3 > 0, key - key % 3).alias("parent_id"),
        F.when(key % 2 == 0, F.concat(F.lit("about "), name)).otherwise("").alias("abstract"), F.repeat(F.concat(F.lit("text of "), name, F.lit("\n")), (key % 9).cast("int")).alias("content"),
        F.when(key % 7 == 0, "archived").otherwise("active").alias("status"), F.date_add(as_of(), (key * 13 % 29).cast("int")).alias("updated_at"), F.when(key % 4 == 0, "seeding").otherwise("mature").alias("maturity"),
    )


@query(PRO + """ SELECT id, title, maturity, parent_id, CASE WHEN parent_id IS NULL AND length(content) > 0 AND length(content) <= 200 THEN content END AS gist,
    row_number() OVER (ORDER BY day DESC, id) AS place FROM pro WHERE owner = 'default' AND status = 'active'""")
def profile_listing(spark, sf):
    """The directory of chapters, newest first; short roots show their content."""
    return in_order(S.profile_directory(_profiles(spark, sf), "default"), "place")


@query(PRO + " SELECT id, row_number() OVER (ORDER BY day DESC, id) AS place FROM pro WHERE owner = 'team' AND status = 'active'")
def profiles_in_order(spark, sf):
    return in_order(S.profiles_newest_first(_profiles(spark, sf), "team").select("id"), "place")


SHOWN = rf"regexp_replace(c.content, '{BLANK}', ' ', 'g')"


@query(PRO + f""" SELECT c.id, p.title AS parent_title, CASE WHEN p.title IS NULL THEN c.title ELSE p.title || ' / ' || c.title END AS shown,
    CASE WHEN c.abstract <> '' THEN c.abstract ELSE {clipped_sql(SHOWN, 120)} END AS gist FROM pro c LEFT JOIN pro p ON p.id = c.parent_id""")
def profile_parents(spark, sf):
    profiles = _profiles(spark, sf)
    return P.with_parents(profiles, profiles).select("id", "parent_title", "shown", "gist")


@query("""WITH d AS (SELECT event_type || (user_id % 9) AS domain, count(*) AS n, max(ts) AS t FROM events GROUP BY 1)
    SELECT domain, n AS demand_count, row_number() OVER (ORDER BY n DESC, t DESC, domain) AS place FROM d ORDER BY n DESC, t DESC, domain LIMIT 10""")
def wanted_domains(spark, sf):
    name = F.concat("event_type", (F.col("user_id") % 9).cast("string"))
    asked = X.table(spark, sf, "events").select(F.lit("default").alias("owner"), F.array(name).alias("domains"), F.col("ts").alias("at"))
    return in_order(S.wanted(U.demands(asked), "default").select("domain", "demand_count"), "place")


# ---- sinks and snapshots ---------------------------------------------------------------------

@query("""SELECT 'd/' || s_suppkey AS theme, '# ' || s_name || chr(10) || chr(10) || '> theme d/' || s_suppkey || ' · v' || s_nationkey || ' · ' || (s_suppkey % 4) || ' memories · mature' || chr(10) || chr(10) || 'about ' || s_name || chr(10) AS page
    FROM supplier WHERE s_suppkey % 6 <> 0""")
def chapter_pages(spark, sf):
    key = F.col("s_suppkey")
    profiles = X.table(spark, sf, "supplier").select(
        F.concat(F.lit("d/"), key.cast("string")).alias("theme"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("version"), F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), (key % 4).cast("int")).alias("memory_ids"),
        F.lit("mature").alias("maturity"), F.concat(F.lit("about "), "s_name").alias("content"), F.when(key % 6 == 0, "archived").otherwise("active").alias("status"),
    )
    return K.chapter_pages(profiles)


@query(MEM + """, l AS (SELECT id, CASE id % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'SUPERSEDE' ELSE 'REFINE' END AS action FROM mem), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY id) AS n FROM l WHERE action <> 'REFINE')
    SELECT action, count(*) AS n, string_agg(CASE WHEN n <= 10 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS ids FROM r GROUP BY action""")
def nightly_report(spark, sf):
    action = F.element_at(F.array(*map(F.lit, ("NEW", "SUPERSEDE", "REFINE"))), (F.col("id") % 3 + 1).cast("int"))
    log = X.memories(spark, sf).select(action.alias("action"), F.when(F.col("id") % 3 < 2, F.col("id")).alias("new_id"))
    return K.nightly_report(log).select("action", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(REQ + """ SELECT '{"id":' || id || ',"step":"' || step || '","input_tokens":' || req_bytes || '}' AS value FROM req""")
def usage_lines(spark, sf):
    return K.usage_lines(X.requests(spark, sf).select("id", "step", F.col("req_bytes").alias("input_tokens")))


@query("""WITH c AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'o1' ELSE 'o2' END AS owner, s_name AS domain, s_suppkey % 11 AS members, repeat(s_name || ' ', CAST(s_suppkey % 5 AS BIGINT)) AS card FROM supplier),
        t AS (SELECT owner, substr(string_agg('## ' || domain || chr(10) || card, chr(10) || chr(10) ORDER BY members DESC, domain), 1, 3000) AS card FROM c GROUP BY owner) SELECT * FROM t WHERE length(card) >= 100""")
def store_cards(spark, sf):
    key = F.col("s_suppkey")
    cards = X.table(spark, sf, "supplier").select(F.when(key % 3 == 0, "o1").otherwise("o2").alias("owner"), F.col("s_name").alias("domain"), (key % 11).alias("members"), F.repeat(F.concat("s_name", F.lit(" ")), (key % 5).cast("int")).alias("card"))
    return K.store_card(cards)


@query(MEM + """, h AS (SELECT coalesce(nullif(trim(domain), ''), 'general') AS domain, count(*) AS n FROM mem WHERE """ + OWN + """ GROUP BY 1) SELECT domain, n AS members FROM h WHERE domain <> 'fr'""")
def stale_cards(spark, sf):
    """Domains whose card was made from other rows, or not at all."""
    hashes = U.domain_hashes(X.memories(spark, sf), F.date_format("last_seen", "yyyy-MM-dd"))
    cards = hashes.select("domain", F.when(F.col("domain") == "fr", F.col("hash")).otherwise("old").alias("hash"))
    return U.stale_cards(hashes, cards).select("domain", "members")


@query(MEM + """ SELECT 'v1' AS version, id, content, status FROM mem UNION ALL SELECT 'now', id, CASE WHEN id % 2 = 0 THEN 'changed' ELSE content END, status FROM mem
    UNION ALL SELECT 'log', id, summary, 'x' FROM mem WHERE id % 3 = 0 UNION ALL SELECT 'log', id, summary, 'x' FROM mem WHERE id % 3 = 1""")
def snapshot_versions(spark, sf):
    """A table as of an older version and now, and one that rows were appended to."""
    store, rows = SnapshotStore(spark, scratch(spark, "store")), X.memories(spark, sf)
    log = rows.select("id", F.lit("x").alias("action"), F.col("summary").alias("detail"))
    store.commit({"memories": rows, "memory_log": log.where("id % 3 = 0")})
    store.append({"memory_log": log.where("id % 3 = 1")})
    store.commit({"memories": store.read("memories").withColumn("content", F.when(F.col("id") % 2 == 0, "changed").otherwise(F.col("content")))})
    shown = lambda df, name: df.select(F.lit(name).alias("version"), "id", "content", "status")
    appended = store.read("memory_log").select(F.lit("log").alias("version"), "id", F.col("detail").alias("content"), F.col("action").alias("status"))
    return shown(store.read("memories", 1), "v1").unionByName(shown(store.read("memories"), "now")).unionByName(appended)


@query("SELECT doc_id, text AS composed FROM documents")
def composed_texts(spark, sf):
    """Texts taken apart into letters and marks, put together again."""
    apart = F.col("text")
    for whole in "\u00e9\u00fc\u00f1\u00e4\u00f6":
        apart = F.replace(apart, F.lit(whole), F.lit(unicodedata.normalize("NFD", whole)))
    return X.table(spark, sf, "documents").select("doc_id", T.nfc(apart).alias("composed"))
