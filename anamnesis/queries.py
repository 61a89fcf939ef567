"""Driver queries over the fixture views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis import fixtures as X
from anamnesis.functions import text as T
from anamnesis.operators import conversations as C
from anamnesis.operators import merging as M
from anamnesis.operators import segments as G
from anamnesis.operators import selection as S
from anamnesis.operators import upkeep as U
from anamnesis.operators import usage as L
from anamnesis.operators.ranking import numbered, union_first
from anamnesis.plans import dream as D
from anamnesis.plans import pick as P
from anamnesis.plans import recall as R
from anamnesis.schema import STATUSES
from anamnesis.sources import inbox as I
from anamnesis.sources import sessions as E
from anamnesis.sources import sync as Y

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MEM = f"WITH mem AS ({X.MEMORIES_SQL})"
OWN = "owner = 'default' AND status = 'active'"
REP = f"WITH rep AS ({X.REPLIES_SQL})"
REQ = f"WITH req AS ({X.REQUESTS_SQL})"
LOWERED = "lower(summary) AS s, lower(keywords) AS k, lower(content) AS c"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def as_of():
    return F.lit(X.AS_OF).cast("date")


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """A short result with ``name``, 1, 2, ... as its rows come."""
    out = [(*r, n) for n, r in enumerate(rows.collect(), 1)]
    return rows.sparkSession.createDataFrame(out, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, {name} long")


def since():
    return F.lit("2024-01-08").cast("timestamp_ntz")


def text_day(column: str = "last_seen"):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# ---- usage and activity ------------------------------------------------------------------

def _tokens(spark, sf):
    return X.requests(spark, sf).select("at", "step", F.col("req_bytes").alias("input_tokens"), F.col("res_bytes").alias("output_tokens"))


@query(REQ + """ SELECT strftime(seen_at, '%Y-%m-%d') AS day, step, CAST(sum(req_bytes) AS BIGINT) AS input, CAST(sum(res_bytes) AS BIGINT) AS output
    FROM req WHERE seen_at >= TIMESTAMP '2024-01-08' GROUP BY 1, 2""")
def token_usage_daily(spark, sf):
    return L.token_usage(_tokens(spark, sf), since())


@query(REQ + """ SELECT strftime(seen_at, '%Y-%m-%d') AS day,
        round(CAST(sum(req_bytes) AS DOUBLE) * 0.2 / 1e6 + CAST(sum(res_bytes) AS DOUBLE) * 0.8 / 1e6, 6) AS spent
    FROM req WHERE step IN ('view', 'click') GROUP BY 1""")
def spend_by_day(spark, sf):
    return L.spend(_tokens(spark, sf), ("view", "click"), 0.2, 0.8).select("day", F.round("spent", 6).alias("spent"))


@query(REQ + """ SELECT day, client, category, count(*) AS n, CAST(sum(req_bytes) AS BIGINT) AS req_bytes, CAST(sum(res_bytes) AS BIGINT) AS res_bytes
    FROM (SELECT strftime(seen_at, '%Y-%m-%d') AS day, category, CASE WHEN client = '' THEN 'unknown' ELSE client END AS client, req_bytes, res_bytes
          FROM req WHERE seen_at >= TIMESTAMP '2024-01-08')
    GROUP BY GROUPING SETS ((day, category), (client, category))""")
def activity_grouping_sets(spark, sf):
    return L.activity(X.requests(spark, sf), since())


@query(REQ + " SELECT id, category, client, req_bytes FROM req ORDER BY id DESC LIMIT 30")
def recent_requests(spark, sf):
    return L.recent_requests(X.requests(spark, sf)).select("id", "category", "client", "req_bytes")


@query(MEM + " SELECT status, count(*) AS n FROM mem WHERE owner = 'default' GROUP BY status")
def memory_counts(spark, sf):
    return S.counts_by_status(X.memories(spark, sf), "default")


@query(REQ + """ SELECT 'm' || CAST(user_id % 7 AS VARCHAR) AS machine, strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') AS first_seen,
        strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') AS last_seen, CAST(sum(req_bytes) AS BIGINT) AS bytes,
        arg_max('10.0.0.' || CAST(user_id % 50 AS VARCHAR), strftime(seen_at, '%Y-%m-%d %H:%M:%S.%f') || ' 10.0.0.' || CAST(user_id % 50 AS VARCHAR)) AS ip
    FROM req GROUP BY 1""")
def machine_ledger(spark, sf):
    rows = X.requests(spark, sf).select(
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("machine"), "at",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("ip"), F.col("req_bytes").alias("bytes"),
    )
    out = L.machine_ledger(rows)
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")]
    return out.select("machine", *shown, "ip", "bytes")


# ---- filters, listings, lookups ----------------------------------------------------------

@query(MEM + f""" SELECT id, kind, summary, pinned, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM mem WHERE {OWN}
    ORDER BY pinned DESC, mem.last_seen DESC, id LIMIT 100""")
def list_memories(spark, sf):
    return S.list_memories(X.memories(spark, sf)).select("id", "kind", "summary", "pinned", text_day())


@query(MEM + f" SELECT id, kind, cwd FROM mem WHERE {OWN} AND (cwd = '/p/src3' OR cwd IS NULL OR kind IN ('preference', 'fact', 'knowledge'))")
def scope_smart(spark, sf):
    return S.owned(X.memories(spark, sf)).where(S.in_scope("smart", "/p/src3")).select("id", "kind", "cwd")


@query(MEM + f" SELECT id, kind, cwd FROM mem WHERE {OWN} AND (cwd = '/p/src3' OR cwd IS NULL)")
def scope_cwd(spark, sf):
    return S.owned(X.memories(spark, sf)).where(S.in_scope("cwd", "/p/src3")).select("id", "kind", "cwd")


@query(MEM + f" SELECT id, evidence, pinned FROM mem WHERE {OWN} AND (pinned = 1 OR evidence >= 3 OR last_seen >= DATE '2024-07-01' - 60)")
def merge_candidates_gate(spark, sf):
    return S.merge_candidates(X.memories(spark, sf), as_of(), 60).select("id", "evidence", "pinned")


@query(MEM + f" SELECT id, summary, content FROM mem WHERE {OWN} AND pinned = 1 ORDER BY confidence DESC, evidence DESC, id LIMIT 5")
def constitution_top5(spark, sf):
    return S.constitution(X.memories(spark, sf), "default").select("id", "summary", "content")


@query(MEM + """, a AS (SELECT s_suppkey * 7 % 500 + 1 AS aid, max(s_suppkey) AS p FROM supplier GROUP BY 1)
    SELECT id, summary, CAST(row_number() OVER (ORDER BY p) AS BIGINT) AS place FROM mem JOIN a ON id = aid WHERE status = 'active'""")
def lookup_by_ids(spark, sf):
    asked = X.table(spark, sf, "supplier").select((F.col("s_suppkey") * 7 % 500 + 1).alias("id"), F.col("s_suppkey").alias("position"))
    return S.by_ids(X.memories(spark, sf), asked).select("id", "summary", F.col("place").cast("long").alias("place"))


@query(MEM + f" SELECT id, substr(summary, 1, 50) || CASE WHEN length(summary) > 50 THEN '…' ELSE '' END AS summary FROM mem WHERE {OWN} AND last_seen > DATE '2024-05-01' ORDER BY id DESC LIMIT 8")
def fresh_strip(spark, sf):
    rows = X.memories(spark, sf).withColumn("created_at", F.col("last_seen"))
    return S.fresh_strip(rows, "default", F.lit("2024-05-01").cast("date"))


@query(MEM + f" SELECT id, kind FROM mem WHERE {OWN} AND (cwd = '/p/src1' OR cwd IS NULL OR kind IN ('preference', 'fact', 'knowledge')) ORDER BY id LIMIT 300")
def deep_pool(spark, sf):
    return S.pool_in_order(X.memories(spark, sf), "default", "smart", "/p/src1").select("id", "kind")


@query(MEM + f" SELECT domain, arg_max(id, evidence * 1000000 - id) AS id, max(evidence) AS evidence, count(*) AS n FROM mem WHERE {OWN} AND domain IS NOT NULL GROUP BY domain")
def domain_leaders(spark, sf):
    rows = S.owned(X.memories(spark, sf)).where("domain IS NOT NULL")
    return rows.groupBy("domain").agg(F.max_by("id", F.col("evidence") * 1000000 - F.col("id")).alias("id"), F.max("evidence").alias("evidence"), F.count("*").alias("n"))


# ---- text functions ----------------------------------------------------------------------

FOLDED_SQL = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}\p{P}\p{S}]+"


@query(rf"SELECT doc_id, sha256(regexp_replace(lower(nfc_normalize(text)), '{FOLDED_SQL}', '', 'g')) AS digest FROM documents")
def content_digest(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.digest(F.col("text")).alias("digest"))


SECRETS = "'a LTAI' || md5('a' || doc_id)[1:16] || ' x sk-' || md5('b' || doc_id) || ' y ghp_' || md5('c' || doc_id) || ' z github_pat_' || md5('d' || doc_id) || ' Access Key Secret: ' || md5('e' || doc_id)"


def _scrubbed_sql(text):
    for pattern, mark in T.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return rf"regexp_replace({text}, '(access ?key(?: ?secret)?(?:是|=|:)\s*)[A-Za-z0-9]{{24,40}}(\s|$)', '\1[redacted-key]\2', 'gim')"


@query(f"SELECT doc_id, {_scrubbed_sql(f'{SECRETS} || chr(10) || text')} AS scrubbed FROM documents")
def scrub_secrets(spark, sf):
    part = lambda letter: F.md5(F.concat(F.lit(letter), F.col("doc_id").cast("string")).cast("binary"))
    secret = F.concat(
        F.lit("a LTAI"), F.substring(part("a"), 1, 16), F.lit(" x sk-"), part("b"), F.lit(" y ghp_"), part("c"), F.lit(" z github_pat_"), part("d"),
        F.lit(" Access Key Secret: "), part("e"),
    )
    return X.table(spark, sf, "documents").select("doc_id", T.scrub(F.concat(secret, F.lit("\n"), "text")).alias("scrubbed"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS clipped FROM documents")
def clip_text(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.clip(F.col("text"), 80).alias("clipped"))


SPLIT_SQL = r"[\t\n\x0B\f\r\p{Z}\x{FEFF},，。.!！?？：:；;、（）()\[\]{}「」“”‘’''\"]+"


@query(rf"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '{SPLIT_SQL}'), lambda t: length(t) >= 2)[1:12], ' ') AS terms FROM benchmark""")
def query_tokens(spark, sf):
    return X.table(spark, sf, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '[\t\n\x0B\f\r\p{Z}\x{FEFF}]+', ' ', 'g') AS squeezed FROM conversations""")
def squeeze_text(spark, sf):
    return X.table(spark, sf, "conversations").select("conv_id", "turn", T.squeeze(F.col("text")).alias("squeezed"))


@query(REP + """ SELECT topic_id, reply_id, len(list_filter(regexp_extract_all(query, '[\\x{4e00}-\\x{9fff}]{2,}|[A-Za-z0-9]{4,}'),
        lambda t: contains(answer, t))) > 0 AS grounded FROM rep WHERE answer <> ''""")
def grounding_check(spark, sf):
    rows = X.replies(spark, sf).where("answer != ''")
    return rows.select("topic_id", "reply_id", T.grounded(F.col("query"), F.col("answer")).alias("grounded"))


@query("""SELECT doc_id, 'It began.' || chr(10) || text || chr(10) || 'He said 注入记忆 in passing' AS kept FROM documents""")
def envelope_strip(spark, sf):
    card = F.concat(
        F.lit("It began.\n  **注入画像：《钓鱼》**\n**注入记忆 12 条**：\n7、 #41 (lesson) knots hold when wet\n"), "text",
        F.lit("\n（*本对话已注入过的 2 条*\nUse the above when it helps, or not\nHe said 注入记忆 in passing"),
    )
    return X.table(spark, sf, "documents").select("doc_id", T.strip_envelope(card).alias("kept"))


@query(r"""SELECT doc_id, regexp_replace('see [图片]! and [代码块] then ' || text, '[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '') AS cleaned FROM documents""")
def clean_text(spark, sf):
    image = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.base64(F.encode(F.lit("picture"), "utf-8")), 60))
    raw = F.concat(F.lit("  see "), image, F.lit("! and ```py\n"), F.replace("text", F.lit("```"), F.lit("")), F.lit("\n``` then "), "text", F.lit(" \n"))
    return X.table(spark, sf, "documents").select("doc_id", T.clean(raw).alias("cleaned"))


@query(MEM + " SELECT id, CASE WHEN length(summary) > 60 THEN substr(summary, 1, 60) || '…' ELSE summary END AS handle, CASE status WHEN 'absorbed' THEN 'absorbed into a profile' WHEN 'superseded' THEN 'superseded by a newer memory' WHEN 'archived' THEN 'archived' ELSE '' END AS label FROM mem")
def handles_and_labels(spark, sf):
    return X.memories(spark, sf).select("id", T.handle(F.col("mini"), F.col("summary")).alias("handle"), T.status_label(F.col("status")).alias("label"))


# ---- retrieval ---------------------------------------------------------------------------

#: Leading characters of a benchmark item that documents embed; the same words for both engines.
def _ask(spark, sf):
    return X.table(spark, sf, "benchmark").orderBy("item_id").select(F.substring("text", 1, 60).alias("q")).first()[0]


TERMS = rf"""terms AS (SELECT unnest(ts) AS t FROM (SELECT list_distinct(list_filter(list_filter(regexp_split_to_array(substr(text, 1, 60), '{SPLIT_SQL}'),
    lambda t: length(t) >= 2)[1:12], lambda t: length(t) LEN)) AS ts FROM benchmark ORDER BY item_id LIMIT 1))"""
LONG_TERMS, SHORT_TERMS = TERMS.replace("LEN", ">= 3"), TERMS.replace("LEN", "= 2").replace("terms AS", "shorts AS")
ALL_TERMS = rf"""asked AS (SELECT unnest(list_filter(list_filter(regexp_split_to_array(substr(text, 1, 60), '{SPLIT_SQL}'),
    lambda t: length(t) >= 2)[1:12], lambda t: length(t) >= 3)) AS t FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1))"""
_COUNT = "len(list_filter(range(1, length({f}) + 1), lambda i: substr({f}, i, length(lower(t))) = lower(t)))"
BM25 = f"""
    , low AS (SELECT *, {LOWERED} FROM mem)
    , size AS (SELECT avg(greatest(length(s) - 2, 0) + greatest(length(k) - 2, 0) + greatest(length(c) - 2, 0)) AS mean, count(*) AS n FROM low)
    , {ALL_TERMS}
    , df AS (SELECT t, count(*) AS d FROM (SELECT DISTINCT t FROM asked), low WHERE contains(s, lower(t)) OR contains(k, lower(t)) OR contains(c, lower(t)) GROUP BY t)
    , hit AS (SELECT low.id, asked.t, s, k, c, greatest(length(s) - 2, 0) + greatest(length(k) - 2, 0) + greatest(length(c) - 2, 0) AS len
        FROM low, asked WHERE low.owner = 'default' AND low.status IN (STATUSES) AND (contains(s, lower(t)) OR contains(k, lower(t)) OR contains(c, lower(t))))
    , tf AS (SELECT id, t, len, CAST({_COUNT.format(f='s')} + {_COUNT.format(f='k')} + {_COUNT.format(f='c')} AS DOUBLE) AS f FROM hit)
    , bm AS (SELECT id, sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS bm25
        FROM tf JOIN df USING (t), size GROUP BY id)
    , fts AS (SELECT id, bm25 FROM bm ORDER BY bm25 DESC, id LIMIT 60)"""
LIKES = f"""
    , {SHORT_TERMS}
    , likes AS (SELECT DISTINCT id FROM (SELECT low.id, row_number() OVER (PARTITION BY t ORDER BY last_seen DESC, low.id DESC) AS r
        FROM low, shorts WHERE owner = 'default' AND status IN (STATUSES) AND (contains(s, lower(t)) OR contains(k, lower(t)) OR contains(c, lower(t)))) WHERE r <= 20)
    , hits AS (SELECT id, h FROM (SELECT id, 1.0 AS h FROM fts UNION ALL SELECT id, 0.5 FROM likes WHERE id NOT IN (SELECT id FROM fts)) JOIN mem USING (id)
        ORDER BY h DESC, last_seen DESC, id LIMIT 60)"""
UNION = """
    , own AS (SELECT * FROM mem WHERE owner = 'default' AND status IN (STATUSES))
    , recent AS (SELECT id FROM own ORDER BY last_seen DESC, id LIMIT 20)
    , ch AS (SELECT id, min(ch) AS channel, max(h) AS h FROM (SELECT id, 0 AS ch, h FROM hits UNION ALL SELECT id, 1, 0.2 FROM recent
        UNION ALL SELECT id, 2, 0.2 FROM own WHERE pinned = 1) GROUP BY id)
    , fused AS (SELECT own.*, channel, h * (1 + 0.3 * pow(0.5, greatest(CAST(DATE '2024-07-01' - last_seen AS DOUBLE), 0) / 30) + 0.1 * ln(1 + evidence) + 0.5 * pinned) AS score
        FROM ch JOIN own USING (id))"""
ACTIVE, EVERY = "'active'", ", ".join(f"'{s}'" for s in STATUSES)


@query((MEM + BM25 + " SELECT id, round(bm25, 6) AS bm25 FROM fts").replace("STATUSES", ACTIVE))
def fts_match_bm25_top60(spark, sf):
    rows = R.bm25_matches(X.memories(spark, sf), T.terms_of(_ask(spark, sf)), "default", ("active",))
    return rows.select("id", F.round("bm25", 6).alias("bm25"))


@query((MEM + BM25 + LIKES + " SELECT id FROM likes").replace("STATUSES", ACTIVE))
def like_fallback(spark, sf):
    return R.short_matches(X.memories(spark, sf), T.terms_of(_ask(spark, sf)), "default", ("active",)).select("id")


@query((MEM + BM25 + LIKES + UNION + " SELECT id, channel, CAST(h AS DOUBLE) AS hit_score FROM ch").replace("STATUSES", ACTIVE))
def channel_union(spark, sf):
    return R.candidates(X.memories(spark, sf), _ask(spark, sf), "default", ("active",)).select("id", "channel", "hit_score")


@query((MEM + BM25 + LIKES + UNION + " SELECT id, round(score, 6) AS score FROM fused WHERE (cwd = '/p/src3' OR cwd IS NULL OR kind IN ('preference', 'fact', 'knowledge')) ORDER BY fused.score DESC, channel, id LIMIT 5").replace("STATUSES", ACTIVE))
def recall_fast_topk(spark, sf):
    rows = R.fast_recall(X.memories(spark, sf), _ask(spark, sf), as_of(), 5, scope="smart", cwd="/p/src3")
    return rows.select("id", F.round("score", 6).alias("score"))


@query((MEM + BM25 + LIKES + UNION + " SELECT id, status, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, channel, id LIMIT 10").replace("STATUSES", EVERY))
def recall_excavate_topk(spark, sf):
    rows = R.fast_recall(X.memories(spark, sf), _ask(spark, sf), as_of(), 10, excavate=True)
    return rows.select("id", "status", F.round("score", 6).alias("score"))


@query((MEM + BM25 + LIKES + UNION + " SELECT id, round(score, 6) AS score FROM fused WHERE id % 3 <> 0 ORDER BY fused.score DESC, channel, id LIMIT 8").replace("STATUSES", ACTIVE))
def ledger_filtered_recall(spark, sf):
    memories = X.memories(spark, sf)
    given = memories.where("id % 3 = 0").select(F.concat(F.lit("m:"), F.col("id").cast("string")).alias("item"))
    rows = R.fast_recall(memories, _ask(spark, sf), as_of(), 8, ledger=given)
    return rows.select("id", F.round("score", 6).alias("score"))


@query()
def recall_all_questions(spark, sf):
    """The fused ranking for every row of ``benchmark``. SQL that compares all terms with all contents takes too
    long; a test holds it against the ranking of one question at a time."""
    questions = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), "text")
    rows = R.recall_many(X.memories(spark, sf), questions, as_of(), 5, scope="smart", cwd="/p/src3")
    return rows.select("question", "id", "channel", F.round("score", 6).alias("score"))


# ---- conversations -----------------------------------------------------------------------

@query("SELECT conv_id AS topic_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS reply_id, substr(text, 1, 20000) AS query FROM conversations WHERE role = 'user'")
def reply_numbering(spark, sf):
    return C.numbered_turns(X.table(spark, sf, "conversations").where("role = 'user'"))


@query(REP + " SELECT topic_id, reply_id, query FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY reply_id DESC) AS n FROM rep) WHERE n <= 3")
def last3_turns(spark, sf):
    return C.last_turns(X.replies(spark, sf)).select("topic_id", "reply_id", "query")


@query(REP + " SELECT topic_id, max(reply_id) AS reply_id FROM rep WHERE answer = '' GROUP BY topic_id")
def unanswered_replies(spark, sf):
    return C.latest_unanswered(X.replies(spark, sf)).select("topic_id", F.col("reply_id").cast("long").alias("reply_id"))


GISTED = REP + ", g AS (SELECT topic_id, reply_id, query, answer, CASE WHEN answer = '' OR (topic_id + reply_id) % 3 = 0 THEN '' ELSE substr(answer, 1, 90) END AS gist FROM rep)"


def _gisted(spark, sf):
    skip = (F.col("answer") == "") | ((F.col("topic_id") + F.col("reply_id")) % 3 == 0)
    return X.replies(spark, sf).withColumn("gist", F.when(skip, "").otherwise(F.substring("answer", 1, 90)))


@query(GISTED + """, ranked AS (SELECT a.topic_id, a.reply_id, b.reply_id AS r, b.gist,
        row_number() OVER (PARTITION BY a.topic_id, a.reply_id ORDER BY b.reply_id DESC) AS n
        FROM g a JOIN g b ON a.topic_id = b.topic_id AND b.reply_id < a.reply_id AND b.gist <> '')
    SELECT g.topic_id, g.reply_id, coalesce(string_agg(CAST(r AS VARCHAR) || '. ' || ranked.gist, '|' ORDER BY r), '') AS gists
    FROM g LEFT JOIN ranked ON g.topic_id = ranked.topic_id AND g.reply_id = ranked.reply_id AND n <= 3 GROUP BY 1, 2""")
def recent_gists(spark, sf):
    return C.earlier_gists(_gisted(spark, sf)).select("topic_id", "reply_id", F.array_join("gists", "|").alias("gists"))


SQUEEZED = r"regexp_replace(query, '[\t\n\x0B\f\r\p{Z}\x{FEFF}]+', ' ', 'g')"


@query(GISTED + f""", lines AS (SELECT topic_id, reply_id, row_number() OVER (PARTITION BY topic_id ORDER BY reply_id DESC) AS n,
            length(CAST(reply_id AS VARCHAR)) + 2 + least(length({SQUEEZED}), 4000) + CASE WHEN length({SQUEEZED}) > 4000 THEN 1 ELSE 0 END AS v,
            length(CAST(reply_id AS VARCHAR)) + 2 + CASE WHEN gist <> '' THEN length(gist)
                ELSE 3 + least(length({SQUEEZED}), 300) + CASE WHEN length({SQUEEZED}) > 300 THEN 1 ELSE 0 END END AS l FROM g)
    , base AS (SELECT topic_id, sum(v) + count(*) - 1 + 9 AS fixed FROM lines WHERE n <= 3 GROUP BY topic_id)
    , run AS (SELECT l.*, fixed + sum(CASE WHEN n <= 3 THEN 0 ELSE l END) OVER (PARTITION BY topic_id ORDER BY n) AS used FROM lines l JOIN base USING (topic_id))
    , over AS (SELECT *, max(CASE WHEN n > 3 AND used + 20 > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id ORDER BY n) AS stop FROM run)
    SELECT topic_id, reply_id, CASE WHEN n <= 3 THEN 'verbatim' ELSE 'gist' END AS part, CAST(CASE WHEN n <= 3 THEN v ELSE l END AS BIGINT) AS chars FROM over WHERE stop = 0""")
def context_budget_pack(spark, sf):
    return C.packed_context(_gisted(spark, sf), F.lit(""), 600).drop("line")


@query(REP + """, t AS (SELECT topic_id, max(reply_id) AS last, topic_id % 2 AS since FROM rep GROUP BY topic_id)
    , old AS (SELECT topic_id, last - since AS turns FROM t WHERE last - since >= 3)
    , r AS (SELECT topic_id, query, row_number() OVER (PARTITION BY topic_id ORDER BY reply_id DESC) AS n FROM rep)
    SELECT old.topic_id, CAST(turns AS BIGINT) AS turns, count(query) AS sent FROM old LEFT JOIN r ON old.topic_id = r.topic_id AND n <= 12
        AND length(regexp_replace(query, '[\\s\\p{Z}]', '', 'g')) >= 15 GROUP BY 1, 2""")
def stale_topics(spark, sf):
    replies = X.replies(spark, sf)
    topics = replies.select("topic_id").distinct().withColumn("summary_at", (F.col("topic_id") % 2).cast("long"))
    return C.stale_topics(replies, topics, 3)


@query(REP + " SELECT topic_id, reply_id FROM rep WHERE answer <> '' AND topic_id % 30 >= 12 ORDER BY topic_id DESC, reply_id LIMIT 150")
def gist_regen_selection(spark, sf):
    replies = X.replies(spark, sf)
    seen = F.date_add(F.lit("2024-06-01").cast("date"), (F.col("topic_id") % 30).cast("int"))
    topics = replies.select("topic_id").distinct().withColumn("last_seen", seen)
    return C.gists_to_regenerate(replies, topics, F.lit("2024-06-12").cast("date"))


@query(REP + """, p AS (SELECT topic_id, max(reply_id) AS reply_id FROM rep WHERE answer = '' GROUP BY topic_id)
    SELECT rep.topic_id, rep.reply_id, CASE WHEN p.reply_id IS NOT NULL THEN 'late answer ' || rep.topic_id ELSE answer END AS answer
    FROM rep LEFT JOIN p ON rep.topic_id = p.topic_id AND rep.reply_id = p.reply_id""")
def attach_answers(spark, sf):
    replies = X.replies(spark, sf)
    late = replies.select("topic_id").distinct().select("topic_id", F.lit(1).alias("seq"), F.concat(F.lit("late answer "), F.col("topic_id").cast("string")).alias("answer"))
    return C.attach_answers(replies, late).select("topic_id", "reply_id", "answer")


@query("""SELECT CAST(user_id % 40 AS VARCHAR) AS conversation, event_type AS item, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS injected_at
    FROM events WHERE event_id % 2 = 1 OR ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR GROUP BY 1, 2""")
def injection_ledger(spark, sf):
    rows = X.table(spark, sf, "events").select((F.col("user_id") % 40).cast("string").alias("conversation"), F.col("event_type").alias("item"), F.col("ts").alias("injected_at"), "event_id")
    out = C.log_injections(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return out.withColumn("injected_at", F.date_format("injected_at", "yyyy-MM-dd HH:mm:ss"))


# ---- segments ----------------------------------------------------------------------------

@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    , f AS (SELECT conv_id, turn, n, 0 AS segment, CASE WHEN s + 1 >= 900 THEN 0 ELSE s + 1 END AS used, CASE WHEN s + 1 >= 900 THEN 1 ELSE 0 END AS full FROM r WHERE n = 1
        UNION ALL SELECT r.conv_id, r.turn, r.n, f.segment + f.full, CASE WHEN f.used + s + 1 >= 900 THEN 0 ELSE f.used + s + 1 END,
            CASE WHEN f.used + s + 1 >= 900 THEN 1 ELSE 0 END FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
    SELECT conv_id, turn, CAST(segment AS BIGINT) AS segment FROM f""")
def greedy_segments(spark, sf):
    lines = X.table(spark, sf, "conversations").withColumn("size", F.length("text"))
    return G.greedy_segments(lines, "conv_id", "turn", "size", 900)


@query("""SELECT doc_id, w.o AS "offset", md5(substr(text, CAST(w.o + 1 AS BIGINT), 8000)) AS digest FROM documents, LATERAL (SELECT unnest(range(0, length(text), 8000)) AS o) w
    WHERE length(text) > 0 AND length(trim(substr(text, CAST(w.o + 1 AS BIGINT), 8000), ' ')) >= 200""")
def fixed_windows(spark, sf):
    out = G.fixed_windows(X.table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "offset", F.md5(F.col("window").cast("binary")).alias("digest"))


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 50000")
def nightly_budget(spark, sf):
    return G.within_budget(X.table(spark, sf, "documents"), "source", ["doc_id"], "n_chars", 50_000).select("doc_id", "n_chars")


# ---- store maintenance -------------------------------------------------------------------

@query(MEM + rf""", d AS (SELECT id, owner, status, sha256(regexp_replace(lower(nfc_normalize(content)), '{FOLDED_SQL}', '', 'g')) AS digest FROM mem)
    SELECT id FROM d WHERE status <> 'archived' AND (owner, digest) NOT IN (SELECT (owner, digest) FROM d WHERE status = 'archived')""")
def tombstone_blocked(spark, sf):
    memories = X.memories(spark, sf)
    stones = M.tombstones_of(memories.where("status = 'archived'"), "archived", as_of())
    return M.without_tombstoned(memories.where("status != 'archived'"), stones).select("id")


@query(MEM + " SELECT id FROM mem WHERE status = 'active' AND pinned = 0 AND origin = 'agent_inferred' AND confidence < 0.7 AND last_seen < DATE '2024-07-01' - 90")
def decay_candidates(spark, sf):
    return U.decayed(X.memories(spark, sf), as_of()).select("id")


@query(MEM + " SELECT id FROM mem WHERE status = 'active' AND pinned = 0 AND evidence < 5 AND last_seen < DATE '2024-07-01' - 30")
def absorb_eligible(spark, sf):
    return X.memories(spark, sf).where(U.absorbable(as_of())).select("id")


@query(MEM + f""", m AS (SELECT coalesce(nullif(trim(domain), ''), 'general') AS domain, id, CAST(id AS VARCHAR) || ':' || strftime(last_seen, '%Y-%m-%d') AS mark FROM mem WHERE {OWN})
    , r AS (SELECT domain, CAST(floor(id / 1000) AS BIGINT) AS range, md5(string_agg(mark, ';' ORDER BY id)) AS hash, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT domain, CAST(sum(n) AS BIGINT) AS members, substr(md5(string_agg(hash, ';' ORDER BY range)), 1, 16) AS hash FROM r GROUP BY domain""")
def domain_hash(spark, sf):
    return U.domain_hashes(X.memories(spark, sf), F.date_format("last_seen", "yyyy-MM-dd"))


@query(MEM + f" SELECT count(*) AS n FROM mem WHERE {OWN} AND NOT (pinned = 1 OR (kind = 'preference' AND evidence >= 5 AND confidence >= 0.8))")
def flexible_count(spark, sf):
    return U.flexible(X.memories(spark, sf)).agg(F.count("*").alias("n"))


@query(MEM + f""", g AS (SELECT id % 40 AS group_id, id AS place, * FROM mem WHERE {OWN})
    SELECT group_id, CAST(sum(evidence) AS BIGINT) AS evidence, max(confidence) AS confidence, strftime(max(last_seen), '%Y-%m-%d') AS last_seen, count(*) AS members,
        (list(kind ORDER BY confidence DESC, place))[1] AS kind, (list(cwd ORDER BY confidence DESC, place))[1] AS cwd FROM g GROUP BY group_id HAVING count(*) >= 2""")
def reorg_merge_groups(spark, sf):
    rows = S.owned(X.memories(spark, sf)).withColumn("source", F.col("cwd"))
    groups = rows.select((F.col("id") % 40).alias("group_id"), F.col("id").alias("place"), "id")
    out = U.merged_groups(rows, groups)
    return out.select("group_id", "evidence", "confidence", text_day(), "members", "kind", "cwd")


@query(MEM + """ SELECT a.id AS keep_id, b.id AS drop_id FROM mem a JOIN mem b ON b.id = a.id + 1
    WHERE NOT (b.origin = 'user_stated' AND b.confidence >= 0.8) OR (a.origin = 'user_stated' AND a.confidence >= 0.8)""")
def conflict_gate(spark, sf):
    memories = X.memories(spark, sf)
    pairs = memories.select(F.col("id").alias("keep_id"), (F.col("id") + 1).alias("drop_id"))
    return U.allowed_conflicts(memories, pairs)


@query(MEM + """, p AS (SELECT id % 60 AS profile, id, status, (id % 7 < 3) AS covered FROM mem WHERE owner = 'default')
    , s AS (SELECT profile, count(*) FILTER (status IN ('active', 'absorbed')) AS loadable, count(*) FILTER (status IN ('active', 'absorbed') AND covered) AS covered FROM p GROUP BY profile)
    SELECT profile AS id, 't' || profile AS theme, loadable, covered FROM s WHERE profile % 10 <> 0 AND (loadable = 0 OR covered >= 0.5 * loadable OR profile % 9 = 1)""")
def profile_coverage_retirement(spark, sf):
    memories = X.memories(spark, sf).where("owner = 'default'")
    name = lambda c: F.concat(F.lit(c), (F.col("id") % 60).cast("string"))
    profiles = memories.groupBy((F.col("id") % 60).alias("id")).agg(F.collect_list("id").alias("memory_ids"))
    profiles = profiles.select("id", name("t").alias("theme"), F.when(F.col("id") % 9 == 1, "same").otherwise(name("title ")).alias("title"), "memory_ids")
    touched = profiles.where("id % 10 = 0").select("theme", F.lit("same").alias("title"))
    return U.retired(profiles, memories, memories.where("id % 7 < 3"), touched).select("id", "theme", "loadable", "covered")


@query(MEM + """, p AS (SELECT id % 50 AS profile, id FROM mem WHERE owner = 'default')
    , big AS (SELECT profile FROM p GROUP BY profile HAVING count(*) >= 5)
    SELECT mem.id, profile AS absorbed_by FROM mem JOIN p USING (id) JOIN big USING (profile)
    WHERE status = 'active' AND pinned = 0 AND evidence < 5 AND last_seen < DATE '2024-07-01' - 30 AND profile > 0""")
def absorption(spark, sf):
    memories = X.memories(spark, sf)
    rows = memories.where("owner = 'default'").groupBy((F.col("id") % 50).alias("id")).agg(F.collect_list("id").alias("memory_ids"))
    parent = F.when(F.col("id") > 0, 0)
    profiles = rows.withColumns({"maturity": F.when(F.size("memory_ids") >= 5, "mature").otherwise("seeding"), "parent_id": parent})
    return U.absorb(memories, profiles, as_of())


@query("""WITH o AS (SELECT s_suppkey AS id, 'default' AS owner, 't' || s_suppkey AS theme, s_name AS title, 'old' AS abstract, CASE WHEN s_suppkey % 4 = 0 THEN 'archived' ELSE 'active' END AS status, s_nationkey AS version FROM supplier)
    , n AS (SELECT 't' || s_suppkey AS theme, 'new ' || s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'fresh' END AS abstract FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'x' || r_regionkey, r_name, 'fresh' FROM region)
    SELECT coalesce(o.theme, n.theme) AS theme, coalesce(n.title, o.title) AS title, coalesce(nullif(n.abstract, ''), o.abstract, '') AS abstract,
        CASE WHEN n.theme IS NULL THEN o.status ELSE 'active' END AS status, CAST(coalesce(version, 0) + CASE WHEN n.theme IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version
    FROM o FULL JOIN n ON o.theme = n.theme""")
def profile_upsert(spark, sf):
    s, none = X.table(spark, sf, "supplier"), F.array().cast("array<long>")
    key = F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))
    rest = {"owner": F.lit("default"), "content": F.lit("c"), "memory_ids": none, "maturity": F.lit("mature"), "parent_id": F.lit(None).cast("long")}
    old = s.select(F.col("s_suppkey").alias("id"), key.alias("theme"), F.col("s_name").alias("title"), F.lit("old").alias("abstract"), F.when(F.col("s_suppkey") % 4 == 0, "archived").otherwise("active").alias("status"), F.col("s_nationkey").cast("long").alias("version"), as_of().alias("updated_at")).withColumns(rest)
    new = s.where("s_suppkey % 2 = 0").select(key.alias("theme"), F.concat(F.lit("new "), "s_name").alias("title"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("fresh").alias("abstract"))
    more = X.table(spark, sf, "region").select(F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("theme"), F.col("r_name").alias("title"), F.lit("fresh").alias("abstract"))
    out = U.upsert_profiles(old, new.unionByName(more).withColumns(rest), as_of())
    return out.select("theme", "title", "abstract", "status", "version")


ACTIONS_SQL = """, act AS (SELECT id * 10 + j AS seq, id AS target_id, (id * 7 + j * 3) % 4 AS a, j, (id * 11 + j * 5) % 10 AS q FROM mem, (VALUES (1), (2), (3)) AS v(j) WHERE owner = 'default')"""


@query(MEM.replace("WITH", "WITH RECURSIVE", 1) + ACTIONS_SQL + """
    , f AS (SELECT id, 0 AS j, CAST(evidence AS BIGINT) AS evidence, confidence, origin, status, CAST(0 AS BIGINT) AS blocked FROM mem WHERE owner = 'default'
      UNION ALL SELECT f.id, act.j,
        f.evidence + CASE WHEN a IN (0, 1) OR (a = 2 AND prot AND NOT strong) THEN 1 ELSE 0 END,
        CASE WHEN a = 0 OR (a = 2 AND prot AND NOT strong) THEN least(1.0, confidence + 0.05) ELSE confidence END, origin,
        CASE WHEN a = 2 AND NOT (prot AND NOT strong) THEN 'superseded' ELSE status END,
        blocked + CASE WHEN a = 2 AND prot AND NOT strong THEN 1 ELSE 0 END
      FROM (SELECT *, origin = 'user_stated' AND confidence >= 0.8 AS prot FROM f) f JOIN (SELECT *, q >= 8 AS strong FROM act) act ON act.target_id = f.id AND act.j = f.j + 1)
    SELECT id, evidence, round(confidence, 6) AS confidence, status, blocked FROM f WHERE j = 3""")
def merge_actions_fold(spark, sf):
    """Three actions on each row of an owner; a reinforcement can close the gate for a later
    supersession."""
    memories = X.memories(spark, sf)
    a, q = (F.col("id") * 7 + F.col("j") * 3) % 4, (F.col("id") * 11 + F.col("j") * 5) % 10
    targets = memories.where("owner = 'default'").withColumn("j", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    kind = F.when(a == 0, "REINFORCE").when(a == 1, "REFINE").when(a == 2, "SUPERSEDE").otherwise("NONE")
    actions = targets.select(
        (F.col("id") * 10 + F.col("j")).alias("seq"), kind.alias("action"), F.col("id").alias("target_id"), "owner", F.lit("s").alias("summary"), F.lit("c").alias("content"),
        F.array(F.lit("k")).alias("keywords"), F.when(q >= 8, "user_stated").otherwise("agent_inferred").alias("origin"), F.when(q >= 8, 0.9).otherwise(0.95).alias("confidence"), F.lit(False).alias("tombstoned"),
    )
    out = M.fold_actions(memories, actions)
    return out.select("id", "evidence", F.round("confidence", 6).alias("confidence"), "status", "blocked")


@query(MEM + """ SELECT id, CASE WHEN id % 4 = 1 THEN 'rewritten ' || id ELSE summary END AS summary, CASE WHEN id % 4 = 2 THEN 'fact' ELSE kind END AS kind,
        CASE WHEN id % 4 = 3 THEN 'archived' ELSE status END AS status FROM mem WHERE status = 'active' AND kind = 'lesson' AND id % 4 <> 0""")
def audit_apply(spark, sf):
    memories = X.memories(spark, sf)
    verdict = F.element_at(F.array(*map(F.lit, ("ok", "rewrite", "fact", "archive"))), (F.col("id") % 4 + 1).cast("int"))
    verdicts = memories.select("id", verdict.alias("verdict"), F.concat(F.lit("rewritten "), F.col("id").cast("string")).alias("summary"), F.lit("").alias("content"))
    return U.audited(memories, verdicts).select("id", "summary", "kind", "status")


@query(MEM + f" SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 20) AS BIGINT) AS batch FROM mem WHERE {OWN} AND mini = ''")
def backfill_batches(spark, sf):
    return U.backfill_batches(X.memories(spark, sf), "mini")


@query(MEM + f" SELECT id, 'w1 w2 w3 w4 w5 w6 w7 w8' AS keywords, substr('handle ' || content, 1, 60) AS mini FROM (SELECT id, content FROM mem WHERE {OWN})")
def backfill_apply(spark, sf):
    rows = S.owned(X.memories(spark, sf)).withColumn("keywords", F.lit(""))
    words = F.array(*(F.lit(f"w{i}") for i in range(1, 11)))
    return U.backfilled(rows, rows.select("id", words.alias("keywords"), F.concat(F.lit("handle "), "content").alias("mini")))


@query("""SELECT 'u' || CAST(user_id % 9 AS VARCHAR) AS owner, d AS domain, count(*) AS demand_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_demand_at
    FROM (SELECT user_id, ts, unnest([event_type, 'd' || CAST(event_id % 4 AS VARCHAR)]) AS d FROM events) GROUP BY 1, 2""")
def demand_counts(spark, sf):
    asked = X.table(spark, sf, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("owner"),
        F.array(F.concat(F.lit(" "), "event_type"), F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")), F.lit(" ")).alias("domains"), F.col("ts").alias("at"),
    )
    return U.demands(asked).withColumn("last_demand_at", F.date_format("last_demand_at", "yyyy-MM-dd HH:mm:ss"))


@query(MEM + f""", sub AS (SELECT CASE WHEN id % 3 = 0 THEN 'a/b' ELSE 'c' || CAST(id % 3 AS VARCHAR) END AS domain, id % 3 AS dp, id % 11 AS sp, id FROM mem WHERE {OWN})
    , ok AS (SELECT dp, sp, replace(domain, '/', '-') AS domain, list_sort(list(DISTINCT id)) AS ids, row_number() OVER (PARTITION BY dp ORDER BY sp) AS n FROM sub GROUP BY dp, sp, domain HAVING count(*) >= 2)
    SELECT domain || '/s' || CAST(sp AS VARCHAR) AS theme, array_to_string(ids, ',') AS members, CASE WHEN len(ids) >= 5 THEN 'mature' ELSE 'seeding' END AS maturity FROM ok WHERE n <= 6""")
def chapter_tree(spark, sf):
    rows = X.memories(spark, sf).where("owner = 'default'").withColumn("dp", F.col("id") % 3)
    name = F.when(F.col("dp") == 0, " a/b ").otherwise(F.concat(F.lit("c"), F.col("dp").cast("string")))
    tree = rows.groupBy(F.col("dp").alias("domain_place"), name.alias("domain"), (F.col("id") % 11).alias("sub_place")).agg(F.collect_list("id").alias("member_ids"))
    tree = tree.withColumn("sub", F.concat(F.lit("s"), F.col("sub_place").cast("string")))
    out = U.chapters(tree, X.memories(spark, sf))
    return out.select("theme", F.array_join(F.col("member_ids").cast("array<string>"), ",").alias("members"), "maturity")


@query(MEM + f" SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS number FROM mem WHERE {OWN}")
def dense_ids(spark, sf):
    return numbered(S.owned(X.memories(spark, sf)).select("id"), "id")


@query(MEM + """ SELECT id, min(c) AS channel FROM (SELECT id, 0 AS c FROM mem WHERE id % 2 = 0 UNION ALL SELECT id, 1 FROM mem WHERE id % 3 = 0) GROUP BY id""")
def first_channel_wins(spark, sf):
    rows = X.memories(spark, sf).select("id")
    return union_first([rows.where("id % 2 = 0"), rows.where("id % 3 = 0")], "id")


# ---- sessions, pushes, files ---------------------------------------------------------------

@query(r"""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN NULL WHEN doc_id % 6 = 2 THEN NULL
        WHEN doc_id % 6 = 3 THEN source || '-' || doc_id || '.jsonl' WHEN doc_id % 6 = 4 THEN NULL ELSE 'x/' || source END AS safe FROM documents""")
def path_sanitiser(spark, sf):
    end = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("../"), end)).when(kind == 1, F.concat(F.lit("/"), end)).when(kind == 2, F.concat(F.lit("C:"), end))
        .when(kind == 3, end).when(kind == 4, F.concat(F.lit("a b"), end)).otherwise(F.concat(F.lit("x/"), "source"))
    )
    return X.table(spark, sf, "documents").select("doc_id", Y.safe_path(name, True).alias("safe"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'session-' || doc_id WHEN doc_id % 3 = 1 THEN 'stem-of-a-file-' || doc_id
        ELSE substr(sha256(substr(text, 1, 4096)), 1, 32) END AS uid FROM documents""")
def session_uids(spark, sf):
    rows, n = X.table(spark, sf, "documents"), F.col("doc_id").cast("string")
    agent = F.when(F.col("doc_id") % 3 == 0, "claude-code").otherwise("pi")
    first = F.concat(F.lit('{"sessionId": "session-'), n, F.lit('"}'))
    stem = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("stem-of-a-file-"), n)).otherwise("short")
    return rows.select("doc_id", E.session_uid(agent, first, stem, F.col("text")).alias("uid"))


@query("SELECT user_id % 5 AS machine, user_id AS uid, max(event_id) + 1 AS line_count FROM events GROUP BY 1, 2")
def sync_state(spark, sf):
    lines = X.table(spark, sf, "events").select((F.col("user_id") % 5).alias("machine"), F.col("user_id").alias("uid"), F.col("event_id").alias("line_no"))
    return Y.session_state(lines)


@query("""WITH RECURSIVE p AS (SELECT event_id AS push, user_id AS uid, (event_id % 3) * 10 AS size, CASE WHEN user_id % 4 = 0 THEN 60 END AS total, event_id % 5 AS late,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sum((event_id % 3) * 10) OVER (PARTITION BY user_id ORDER BY event_id) - (event_id % 3) * 10 AS plain FROM events)
    , f AS (SELECT uid, CAST(0 AS BIGINT) AS n, CAST(uid % 2 * 10 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS push, '' AS outcome FROM (SELECT DISTINCT uid FROM p)
        UNION ALL SELECT f.uid, p.n, CAST(CASE WHEN total IS NOT NULL AND f.pos >= total THEN f.pos WHEN plain + f.uid % 2 * 10 = f.pos THEN f.pos + size ELSE f.pos END AS BIGINT), p.push,
            CASE WHEN total IS NOT NULL AND f.pos >= total THEN 'complete' WHEN plain + f.uid % 2 * 10 = f.pos THEN 'stored' ELSE 'offset' END
        FROM f JOIN p ON p.uid = f.uid AND p.n = f.n + 1)
    SELECT uid, push, outcome, pos AS expected FROM f WHERE n > 0""")
def byte_pushes(spark, sf):
    from pyspark.sql import Window

    size = ((F.col("event_id") % 3) * 10).cast("long")
    before = F.sum(size).over(Window.partitionBy("user_id").orderBy("event_id")) - size
    pushes = X.table(spark, sf, "events").select(
        F.col("event_id").alias("push"), F.lit("m").alias("machine"), F.col("user_id").alias("uid"), (before + F.col("user_id") % 2 * 10).alias("offset"),
        size.alias("size"), F.when(F.col("user_id") % 4 == 0, 60).cast("long").alias("total"),
    )
    stored = pushes.select("machine", "uid").distinct().withColumn("bytes", F.col("uid") % 2 * 10)
    return Y.placed_bytes(pushes, stored).select("uid", "push", "outcome", "expected")


@query("""SELECT s_suppkey AS uid, 'new/' || s_suppkey AS path, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE least(s_suppkey * 10, 300) END AS processed FROM supplier""")
def carried_over_offsets(spark, sf):
    key = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit(c), key.cast("string"))
    rows = X.table(spark, sf, "supplier")
    incoming = rows.select(key.alias("uid"), name("new/").alias("path"), F.lit(300).cast("long").alias("bytes"))
    known = rows.where("s_suppkey % 3 != 0").select(key.alias("uid"), name("old/").alias("path"))
    state = rows.select(name("old/").alias("path"), (key * 10).alias("processed_bytes"))
    return Y.carried_over(incoming, known, state)


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) + 1 AS size FROM conversations)
    WHERE turn >= CASE WHEN conv_id % 3 = 0 THEN 0 WHEN size < conv_id % 7 THEN 0 ELSE conv_id % 7 END""")
def lines_to_read(spark, sf):
    name = F.concat(F.lit("p"), F.col("conv_id").cast("string"))
    lines = X.table(spark, sf, "conversations").select(name.alias("path"), F.col("turn").alias("line_no"), "conv_id")
    state = lines.where("conv_id % 3 != 0").select(F.col("path").alias("session_file"), (F.col("conv_id") % 7).alias("processed_bytes")).distinct()
    return D.new_lines(lines, state).select("conv_id", F.col("line_no").alias("turn"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pending' WHEN doc_id % 5 = 0 THEN 'error' WHEN s = 'pending' AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 THEN 'skipped'
        WHEN s = 'skipped' AND doc_id % 7 = 0 THEN 'slimmed' WHEN s = 'pending' THEN 'slimmed' WHEN s IN ('slimmed', 'filtering') AND doc_id % 11 = 0 THEN 'done'
        WHEN s = 'slimmed' THEN 'filtering' ELSE s END AS next
    FROM (SELECT doc_id, ['pending', 'skipped', 'slimmed', 'filtering', 'done'][CAST(doc_id % 5 + 1 AS INT)] AS s FROM documents)""")
def inbox_states(spark, sf):
    n = F.col("doc_id")
    states = F.array(*map(F.lit, ("pending", "skipped", "slimmed", "filtering", "done")))
    state = F.element_at(states, (n % 5 + 1).cast("int"))
    out = I.next_state(state, n % 2 != 0, n % 3 == 0, n % 7 == 0, n % 11 == 0, F.when(n % 5 == 0, "failed"))
    return X.table(spark, sf, "documents").select("doc_id", out.alias("next"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 1")
def kept_windows(spark, sf):
    rows = X.table(spark, sf, "documents").select("doc_id", "source")
    verdicts = rows.where("doc_id % 2 = 1").select("doc_id", (F.col("doc_id") % 4 != 1).alias("keep"))
    return I.kept_windows(rows, verdicts, ["doc_id"])


@query(r"""SELECT conv_id, turn, '【' || CASE role WHEN 'user' THEN '用户' ELSE 'AI' END || '】' || regexp_replace(text, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g') AS line
    FROM conversations WHERE role <> 'system' AND length(regexp_replace(text, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g')) >= 2""")
def dialogue_slimming(spark, sf):
    record = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn", I.slim_line(record).alias("line"))
    return rows.where("line IS NOT NULL")


@query(r"""SELECT conv_id, turn, '[' || role || '] ' || regexp_replace(text, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g') AS line FROM conversations
    WHERE length(regexp_replace(text, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g')) > 0""")
def session_transcripts(spark, sf):
    record = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    lines = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), record.alias("value"))
    return E.parse_pi(lines).select(F.col("path").alias("conv_id"), F.col("line_no").alias("turn"), "line")


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 500) || chr(10) || '…[' || (length(text) - 1000) || ' chars omitted]…' || chr(10) || right(text, 500) ELSE text END AS clipped FROM documents")
def head_tail_clip(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.head_and_tail(F.col("text"), 2000, 500).alias("clipped"))


@query("SELECT page_id, replace(trim(' a/' || page_id || '/b '), '/', '-') AS theme FROM pages")
def theme_names(spark, sf):
    raw = F.concat(F.lit(" a/"), F.col("page_id").cast("string"), F.lit("/b "))
    return X.table(spark, sf, "pages").select("page_id", T.theme_name(raw).alias("theme"))


# ---- decisions -----------------------------------------------------------------------------

@query(MEM + " SELECT id AS index, CASE WHEN id % 4 = 0 THEN 0.25 ELSE confidence END AS confidence, CASE WHEN id % 6 = 0 THEN 'mixed' ELSE origin END AS origin FROM mem WHERE id % 2 = 0")
def verify_verdicts(spark, sf):
    rows = X.memories(spark, sf).select(F.col("id").alias("index"), "confidence", "origin")
    verdicts = rows.select(
        "index", F.when(F.col("index") % 2 == 0, "keep").otherwise("drop").alias("verdict"), F.when(F.col("index") % 4 == 0, 0.25).alias("confidence"),
        F.when(F.col("index") % 6 == 0, "mixed").alias("origin"),
    )
    return M.verified(rows, verdicts)


@query(MEM + """ SELECT c.id AS index, CASE c.id % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'REINFORCE' WHEN 2 THEN 'REFINE' ELSE 'SUPERSEDE' END AS action,
        CASE WHEN c.id % 4 > 0 THEN c.id + 1 END AS target_id FROM mem c LEFT JOIN mem t ON t.id = c.id + 1
    WHERE c.id % 4 = 0 OR (t.status = 'active' AND t.owner = c.owner AND (c.id % 4 = 1 OR (c.id % 5 <> 0 AND (c.id % 4 = 2 OR c.id % 3 <> 0))))""")
def merge_decisions_valid(spark, sf):
    memories, n = X.memories(spark, sf), F.col("id")
    found = memories.select(n.alias("index"), "owner")
    action = F.element_at(F.array(*map(F.lit, ("NEW", "REINFORCE", "REFINE", "SUPERSEDE"))), (n % 4 + 1).cast("int"))
    decisions = memories.select(
        n.alias("index"), action.alias("action"), F.when(n % 4 > 0, n + 1).alias("target_id"), F.when(n % 3 != 0, "s").alias("summary"),
        F.when(n % 5 != 0, "c").otherwise("").alias("content"), F.array(F.lit("k")).alias("keywords"),
    )
    return M.valid_decisions(decisions, found, memories).select("index", "action", "target_id")


@query(MEM + f""", pool AS (SELECT id FROM mem WHERE {OWN} ORDER BY id LIMIT 300), d AS (SELECT item_id * 7 % 40 + 1 AS id, min(item_id) AS place FROM benchmark GROUP BY 1)
    SELECT id, CAST(row_number() OVER (ORDER BY place, id) AS BIGINT) AS n FROM pool JOIN d USING (id) ORDER BY place, id LIMIT 8""")
def picked_in_order(spark, sf):
    from pyspark.sql import Window

    pool = S.pool_in_order(X.memories(spark, sf), "default", "all", None)
    decisions = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("place"), (F.col("item_id") * 7 % 40 + 1).alias("id"))
    rows = P.chosen(pool, decisions, 8)
    return rows.select("id", F.row_number().over(Window.orderBy("place", "id")).cast("long").alias("n"))


@query(MEM + " SELECT 'c' || CAST(id % 3 AS VARCHAR) AS conversation, id, summary FROM mem WHERE id % 5 = 0")
def already_given(spark, sf):
    memories = X.memories(spark, sf)
    ledger = memories.where("id % 5 = 0").select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("conversation"), F.concat(F.lit("m:"), F.col("id").cast("string")).alias("item"))
    return P.already_given(ledger, memories)


@query((MEM + BM25 + LIKES + UNION + """, dom AS (SELECT id FROM own WHERE domain IN ('fr', 'es') ORDER BY evidence DESC, last_seen DESC, id LIMIT 30)
    SELECT id, min(c) AS channel FROM (SELECT id, channel AS c FROM ch UNION ALL SELECT id, 3 FROM dom) GROUP BY id""").replace("STATUSES", ACTIVE))
def domain_channel(spark, sf):
    rows = R.candidates(X.memories(spark, sf), _ask(spark, sf), "default", ("active",), ("fr", "es"))
    return rows.select("id", "channel")


@query(REQ + " SELECT 'r' || CAST(user_id % 25 AS VARCHAR) AS run_id, CAST(sum(req_bytes) AS BIGINT) AS input, CAST(sum(res_bytes) AS BIGINT) AS output, count(*) AS calls FROM req WHERE user_id % 25 <> 0 GROUP BY 1")
def run_totals(spark, sf):
    run = F.when(F.col("user_id") % 25 != 0, F.concat(F.lit("r"), (F.col("user_id") % 25).cast("string")))
    rows = X.requests(spark, sf).select(run.alias("run_id"), F.col("req_bytes").alias("input_tokens"), F.col("res_bytes").alias("output_tokens"))
    return L.run_totals(rows)


@query(MEM + """ (SELECT id, status FROM mem WHERE owner = 'default' AND status = 'active' ORDER BY last_seen DESC, id LIMIT 200)
    UNION ALL (SELECT id, status FROM mem WHERE owner = 'default' AND status = 'absorbed' ORDER BY last_seen DESC, id LIMIT 200)""")
def chapter_material(spark, sf):
    return S.material(X.memories(spark, sf), "default", 200).select("id", "status")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'recall' WHEN 1 THEN 'memories' WHEN 2 THEN 'sync' ELSE 'other' END AS category,
        CASE page_id % 3 WHEN 0 THEN 'me' WHEN 1 THEN 'agent' ELSE '10.0.0.1' END AS client FROM pages""")
def request_attribution(spark, sf):
    n = F.col("page_id")
    path = F.element_at(F.array(*map(F.lit, ("/recall", "/memories/7", "/sync/push", "/x.html"))), (n % 4 + 1).cast("int"))
    header, agent = F.when(n % 3 == 0, " me ").otherwise(""), F.when(n % 3 == 1, "agent/1.2 (x)").otherwise("")
    return X.table(spark, sf, "pages").select("page_id", L.category_of(path).alias("category"), L.client_of(header, agent, F.lit("10.0.0.1")).alias("client"))
