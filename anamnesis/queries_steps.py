"""Driver queries of whole steps: writing, curating, recalling, deciding, streaming, each with its SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from anamnesis import fixtures as X
from anamnesis.operators import conversations as C
from anamnesis.operators import merging as M
from anamnesis.operators import segments as G
from anamnesis.operators import selection as S
from anamnesis.operators import upkeep as U
from anamnesis.operators import usage as L
from anamnesis.plans import dream as D
from anamnesis.plans import ingest as N
from anamnesis.plans import judge as J
from anamnesis.plans import pick as P
from anamnesis.plans import recall as R
from anamnesis.queries import FOLDED_SQL, GISTED, MEM, OWN, REP, REQ, SQUEEZED, _gisted, as_of, in_order, query
from anamnesis.queries_sources import BLANK, STRIPPED, clipped_sql, message, scratch
from anamnesis.schema import TABLES, conform
from anamnesis.snapshots import SnapshotStore
from anamnesis.sources import sessions as E
from anamnesis.streaming import live

def digest_sql(text: str) -> str:
    return f"sha256(regexp_replace(lower(nfc_normalize({text})), '{FOLDED_SQL}', '', 'g'))"


def at():
    return F.lit("2024-07-01 00:00:00").cast("timestamp")


def store_rows(spark, sf):
    """The memories with all columns of the table."""
    rows = X.memories(spark, sf)
    return conform(rows.withColumn("last_seen_at", F.col("last_seen").cast("timestamp")), "memories")


# ---- the state machine -----------------------------------------------------------------------

ACTED = """, act AS (SELECT id AS seq, CASE id % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'REINFORCE' WHEN 2 THEN 'REFINE' ELSE 'SUPERSEDE' END AS action, CASE WHEN id % 5 > 0 THEN id END AS target, owner, summary,
        CASE WHEN id % 7 = 0 THEN gone ELSE 'told ' || id END AS content, id % 2 = 0 AS strong
        FROM (SELECT *, first_value(content) OVER (PARTITION BY owner ORDER BY CAST(status = 'archived' AS INT) DESC, id) AS gone FROM mem) WHERE id % 5 < 4)"""


@query(MEM + ACTED + f""", stone AS (SELECT DISTINCT owner, {digest_sql('content')} AS digest FROM mem WHERE status = 'archived')
    , a AS (SELECT act.*, (act.owner, {digest_sql('act.content')}) IN (SELECT (owner, digest) FROM stone) AS blocked FROM act)
    , d AS (SELECT a.*, m.origin = 'user_stated' AND m.confidence >= 0.8 AND NOT strong AS refused FROM a LEFT JOIN mem m ON m.id = a.target)
    , born AS (SELECT seq, target, owner, content, row_number() OVER (ORDER BY seq) + (SELECT max(id) FROM mem) AS id FROM d WHERE NOT blocked AND (action = 'NEW' OR (action = 'SUPERSEDE' AND NOT refused)))
    SELECT mem.id, mem.owner, CASE WHEN d.action = 'REFINE' THEN d.content ELSE mem.content END AS content, CASE WHEN born.id IS NOT NULL THEN 'superseded' ELSE status END AS status,
        mem.evidence + CASE WHEN d.action IN ('REINFORCE', 'REFINE') OR (d.action = 'SUPERSEDE' AND refused) THEN 1 ELSE 0 END AS evidence,
        round(CASE WHEN d.action = 'REINFORCE' OR (d.action = 'SUPERSEDE' AND refused) THEN least(1.0, mem.confidence + 0.05) ELSE mem.confidence END, 6) AS confidence, born.id AS superseded_by
    FROM mem LEFT JOIN d ON d.target = mem.id LEFT JOIN born ON born.target = mem.id
    UNION ALL SELECT id, owner, content, 'active', 1, CASE WHEN seq % 2 = 0 THEN 0.9 ELSE 0.6 END, NULL FROM born""")
def applied_actions(spark, sf):
    """A batch over the whole store: new rows, support, refinements and successions, of which some meet
    contents that were put away and some a confident statement."""
    memories, n = store_rows(spark, sf), F.col("id")
    kind = F.when(n % 5 == 0, "NEW").when(n % 5 == 1, "REINFORCE").when(n % 5 == 2, "REFINE").otherwise("SUPERSEDE")
    gone = memories.groupBy("owner").agg(F.min_by("content", F.struct(F.col("status") != "archived", "id")).alias("_gone"))
    strong = n % 2 == 0
    actions = memories.where("id % 5 < 4").join(gone, "owner").select(
        n.alias("seq"), kind.alias("action"), F.when(n % 5 > 0, n).alias("target_id"), "owner", F.lit(None).cast("string").alias("cwd"), F.lit("fact").alias("kind"), "domain", "summary",
        F.when(n % 7 == 0, F.col("_gone")).otherwise(F.concat(F.lit("told "), n.cast("string"))).alias("content"), F.array(F.lit("k")).alias("keywords"),
        F.when(strong, "user_stated").otherwise("agent_inferred").alias("origin"), F.when(strong, 0.9).otherwise(0.6).alias("confidence"), F.lit("src").alias("source"),
    )
    stones = M.tombstones_of(memories.where("status = 'archived'"), "archived", at())
    after, _ = M.apply_actions(memories, actions, stones, at())
    return after.select("id", "owner", "content", "status", "evidence", F.round("confidence", 6).alias("confidence"), "superseded_by")


@query(MEM + f""", stone AS (SELECT DISTINCT owner, {digest_sql('content')} AS digest FROM mem WHERE status = 'archived')
    SELECT id AS seq, id + (SELECT max(id) FROM mem) - (SELECT count(*) FROM mem m WHERE m.id <= mem.id AND (m.owner, {digest_sql('m.content')}) IN (SELECT (owner, digest) FROM stone)) AS id,
        CASE WHEN id % 3 = 0 THEN 'lesson' ELSE kind END AS kind, 1 AS evidence FROM mem WHERE (owner, {digest_sql('content')}) NOT IN (SELECT (owner, digest) FROM stone)""")
def inserted_rows(spark, sf):
    """Every memory told again as new: what was put away is refused, unknown kinds become lessons, ids are dense."""
    memories = store_rows(spark, sf)
    stones = M.tombstones_of(memories.where("status = 'archived'"), "archived", at())
    actions = memories.select(F.col("id").alias("seq"), F.lit("NEW").alias("action"), F.lit(None).cast("long").alias("target_id"), "owner", "cwd", F.when(F.col("id") % 3 == 0, "odd").otherwise(F.col("kind")).alias("kind"), "domain", "summary", "content", F.array("keywords").alias("keywords"), "origin", "confidence", "source")
    rows, log = M.inserted(memories, actions, stones, at())
    return rows.join(log, F.col("id") == F.col("new_id")).select("seq", "id", "kind", "evidence")


CHOSEN = "(SELECT min(id) FROM mem WHERE owner = 'default' AND status = 'active')"


@query(MEM + f""" SELECT id, content, evidence FROM mem WHERE owner = 'default' AND id <> {CHOSEN} UNION ALL SELECT id, 'as it was said', evidence + 1 FROM mem WHERE id = {CHOSEN}
    UNION ALL SELECT id, content, evidence FROM mem WHERE owner <> 'default'""")
def remembered(spark, sf):
    """One stated memory, which a judge merges with an old one; of its decisions the first counts."""
    memories = store_rows(spark, sf)
    first = S.owned(memories).agg(F.min("id")).first()[0]
    decided = spark.createDataFrame([(0, "REFINE", first, None, None, None, "as it was said", []), (0, "NEW", None, "fact", None, "x", "y", [])], J.DECISIONS["merge"])
    said = {"kind": "fact", "summary": "s", "content": "what was said", "keywords": [], "origin": "user_stated", "confidence": 0.9}
    out = N.remember(memories, spark.createDataFrame([], TABLES["tombstones"]), J.ReplayJudge({"merge": decided}), said, at())
    return out.whole(memories).select("id", "content", "evidence")


@query("""WITH b AS (SELECT text FROM benchmark ORDER BY item_id LIMIT 1) SELECT 'file' AS source, substr(string_split(text, chr(10))[1], 1, 60) AS summary, substr(text, 1, 500) AS content, 'fact' AS kind FROM b
    UNION ALL SELECT NULL, doc_text[1:60], doc_text, CASE doc_id % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'fact' WHEN 2 THEN 'knowledge' WHEN 3 THEN 'lesson' ELSE 'skill_index' END FROM (SELECT doc_id, text AS doc_text FROM documents)""")
def ingested_text(spark, sf):
    """One text through triage, extraction, checks and merging, into the whole store."""
    text = X.table(spark, sf, "benchmark").orderBy("item_id").first().text
    memories = store_rows(spark, sf)
    out = N.ingest_text(memories, spark.createDataFrame([], TABLES["tombstones"]), J.RuleJudge(), text, "file", at())
    return out.whole(memories).select("source", "summary", "content", "kind")


@query(MEM + f""", o AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM mem WHERE {OWN}), m AS (SELECT n // 10 AS g, * FROM o WHERE n % 10 < 2)
    , made AS (SELECT g, count(*) AS members, sum(evidence) AS evidence FROM m GROUP BY g HAVING count(*) >= 2)
    , ids AS (SELECT g, row_number() OVER (ORDER BY g) + (SELECT max(id) FROM mem) AS new_id FROM made)
    SELECT mem.id, CASE WHEN o.n % 10 < 2 AND new_id IS NOT NULL THEN 'superseded' WHEN o.n % 10 = 4 THEN 'archived' ELSE mem.status END AS status, CASE WHEN o.n % 10 < 2 THEN new_id END AS superseded_by,
        CASE WHEN o.n % 10 = 5 THEN 'knowledge' ELSE mem.kind END AS kind, mem.evidence FROM mem LEFT JOIN o ON o.id = mem.id LEFT JOIN ids ON ids.g = o.n // 10
    UNION ALL SELECT new_id, 'active', NULL, (SELECT arg_max(kind, confidence * 1000000 - n) FROM m WHERE m.g = ids.g), evidence FROM ids JOIN made USING (g)""")
def reorganised_store(spark, sf):
    """A plan's phases over an owner's whole store: pairs merged, some archived, some put under another kind."""
    memories = store_rows(spark, sf).withColumn("last_seen", F.to_date("last_seen_at"))
    rows = D.upkeep.numbered(S.owned(memories).select("id"), "id", name="n")
    groups = rows.where("n % 10 < 2").groupBy(F.floor(F.col("n") / 10).cast("long").alias("group_id")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    merges = groups.select("group_id", F.lit("s").alias("summary"), F.concat(F.lit("merged "), F.col("group_id").cast("string")).alias("content"), F.array(F.lit("k")).alias("keywords"), "ids")
    none = spark.createDataFrame([], "keep_id long, drop_id long")
    retags = rows.where("n % 10 = 5").select("id", F.lit("knowledge").alias("kind"), F.lit("").alias("domain"))
    changes, made, _ = U.reorganise(memories, merges, none, rows.where("n % 10 = 4").select("id"), retags, spark.createDataFrame([], TABLES["tombstones"]), "default", at())
    after = U.reorganised(memories.drop("last_seen"), D.durable(changes), D.durable(made), at())
    return after.select("id", "status", "superseded_by", "kind", "evidence")


@query(MEM + f""", lesson AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 12) AS BIGINT) AS batch FROM mem WHERE {OWN} AND kind = 'lesson')
    SELECT id, batch, CASE id % 4 WHEN 1 THEN 'rewrite' WHEN 2 THEN 'fact' WHEN 3 THEN 'archive' END AS verdict, CASE id % 4 WHEN 1 THEN 'lesson' WHEN 2 THEN 'fact' WHEN 3 THEN 'lesson' END AS kind_after FROM lesson""")
def audit_trail(spark, sf):
    """Lessons in batches of twelve, and what an audit would change in them."""
    memories = X.memories(spark, sf)
    verdict = F.element_at(F.array(*map(F.lit, ("ok", "rewrite", "fact", "archive"))), (F.col("id") % 4 + 1).cast("int"))
    trail = U.audit_trail(memories, memories.select("id", verdict.alias("verdict"), F.lit("s").alias("summary"), F.lit("c").alias("content")))
    return U.audit_batches(memories).join(trail, "id", "left").select("id", "batch", "verdict", F.get_json_object("after", "$.kind").alias("kind_after"))


@query(MEM + f""", sub AS (SELECT kind, coalesce(domain, 'general') AS sub, id FROM mem WHERE {OWN}), old AS (SELECT kind, coalesce(domain, 'general') AS sub, id FROM mem WHERE owner = 'default' AND status IN ('active', 'absorbed') AND id % 3 = 0)
    , n AS (SELECT kind || '/' || sub AS theme, kind, sub, list(id) AS ids FROM sub GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sub) AS place FROM n)
    , g AS (SELECT theme, kind, list_distinct(list_concat(r.ids, coalesce((SELECT list(id) FROM old WHERE old.kind = r.kind AND old.sub = r.sub), []))) AS ids FROM r WHERE place <= 6)
    SELECT theme, len(ids) AS members, list_sum(ids) AS total, CASE WHEN len(ids) >= 5 THEN 'mature' ELSE 'seeding' END AS maturity FROM g
    UNION ALL SELECT kind, count(DISTINCT u), sum(DISTINCT u), CASE WHEN count(DISTINCT u) >= 5 THEN 'mature' ELSE 'seeding' END FROM (SELECT kind, unnest(ids) AS u FROM g) GROUP BY kind""")
def grown_chapters(spark, sf):
    """Chapters by kind and domain with the members that they had before, and a row for each kind."""
    memories = X.memories(spark, sf)
    sub = F.coalesce("domain", F.lit("general"))
    place = F.element_at(F.create_map(*(F.lit(x) for n, k in enumerate(("fact", "knowledge", "lesson", "preference", "skill_index")) for x in (k, n))), F.col("kind"))
    tree = S.owned(memories).groupBy("kind", sub.alias("sub")).agg(F.collect_set("id").alias("member_ids"))
    tree = tree.withColumns({"domain": F.col("kind"), "domain_place": place, "sub_place": F.row_number().over(Window.partitionBy("kind").orderBy("sub"))})
    had = memories.where("owner = 'default' AND id % 3 = 0").groupBy(F.concat_ws("/", "kind", sub).alias("theme")).agg(F.collect_list("id").alias("memory_ids")).withColumn("owner", F.lit("default"))
    out = U.grown_chapters(U.chapters(tree, memories), had, memories, "default")
    total = F.aggregate("member_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("theme", F.size("member_ids").cast("long").alias("members"), total.alias("total"), "maturity")


@query(MEM + """ SELECT id, CASE WHEN id % 2 = 0 AND status = 'active' THEN 'absorbed' ELSE status END AS status, CASE WHEN id % 2 = 0 AND status = 'active' THEN id % 9 END AS absorbed_by FROM mem""")
def absorbed_store(spark, sf):
    memories = store_rows(spark, sf)
    taken = memories.where("id % 2 = 0 AND status = 'active'").select("id", (F.col("id") % 9).alias("absorbed_by"))
    return U.absorbed(memories, taken, at()).select("id", "status", "absorbed_by")


@query(MEM + """ SELECT id, CASE WHEN status = 'active' AND pinned = 0 AND origin = 'agent_inferred' AND confidence < 0.7 AND last_seen < DATE '2024-07-01' - 90 THEN 'archived' ELSE status END AS status FROM mem""")
def faded_store(spark, sf):
    """The store after a night's decay."""
    memories = store_rows(spark, sf)
    old = U.decayed(memories.withColumn("last_seen", F.to_date("last_seen_at")), as_of())
    return U.archive(memories, old, "decay", at())[0].select("id", "status")


# ---- recall ----------------------------------------------------------------------------------

@query(MEM + f""", pool AS (SELECT id, kind, summary FROM mem WHERE {OWN} ORDER BY id LIMIT 300), d AS (SELECT item_id * 7 % 60 + 1 AS id, min(item_id) AS place FROM benchmark GROUP BY 1)
    , hint AS (SELECT 'memory' AS what, id, kind, summary, place FROM pool JOIN d USING (id) ORDER BY place, id LIMIT 8)
    , pr AS (SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey - s_suppkey % 3 END AS parent FROM supplier), pd AS (SELECT item_id * 5 % 9 + 1 AS id, min(item_id) AS place FROM benchmark GROUP BY 1)
    , pro AS (SELECT 'profile', pr.id, 'profile', CASE WHEN p.title IS NULL THEN pr.title ELSE p.title || ' / ' || pr.title END, place FROM pr JOIN pd ON pd.id = pr.id LEFT JOIN pr p ON p.id = pr.parent ORDER BY place, pr.id LIMIT 5)
    SELECT what, id, kind, summary FROM hint UNION ALL SELECT * EXCLUDE (place) FROM pro""")
def probed(spark, sf):
    """Pointers to up to eight memories and five chapters."""
    items, key = X.table(spark, sf, "benchmark"), F.col("s_suppkey")
    none = F.lit(None).cast("long")
    picks = items.select(F.col("item_id").alias("place"), (F.col("item_id") * 7 % 60 + 1).alias("id"), none.alias("profile_id"))
    picks = picks.unionByName(items.select(F.col("item_id").alias("place"), none.alias("id"), (F.col("item_id") * 5 % 9 + 1).alias("profile_id")))
    profiles = X.table(spark, sf, "supplier").select(key.alias("id"), F.lit("default").alias("owner"), F.col("s_name").alias("title"), F.when(key % 3 > 0, key - key % 3).alias("parent_id"), F.lit("").alias("abstract"), F.lit("c").alias("content"), F.lit("active").alias("status"))
    return P.probe(X.memories(spark, sf), J.ReplayJudge({"pick": picks}), profiles=profiles)


@query(MEM + f""", pool AS (SELECT * FROM mem WHERE {OWN} ORDER BY id LIMIT 300), fresh AS (SELECT * FROM pool WHERE id % 3 <> 0), d AS (SELECT item_id * 7 % 60 + 1 AS id, min(item_id) AS place FROM benchmark GROUP BY 1)
    , hit AS (SELECT id, content FROM fresh JOIN d USING (id) ORDER BY place, id LIMIT 6)
    SELECT id, content, (SELECT count(*) FROM pool) - (SELECT count(*) FROM fresh) AS deduped, row_number() OVER () AS place FROM hit""")
def recall_driver(spark, sf):
    """A question answered by a selector, without what the conversation had; with how many that were."""
    memories = X.memories(spark, sf)
    ledger = memories.where("id % 3 = 0").select(F.concat(F.lit("m:"), F.col("id").cast("string")).alias("item"))
    picks = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("place"), (F.col("item_id") * 7 % 60 + 1).alias("id"), F.lit(None).cast("long").alias("profile_id"))
    found = P.deep_recall(memories, J.ReplayJudge({"pick": picks}), "any question", as_of(), 6, ledger=ledger)
    return in_order(found.memories.select("id", "content", F.lit(found.deduped).cast("long").alias("deduped")), "place")


@query(MEM + f""" (SELECT 'listing' AS part, id, '[id ' || id || '] (' || kind || ') ' || {clipped_sql('summary', 60)} AS line FROM mem WHERE {OWN} ORDER BY id LIMIT 300)
    UNION ALL SELECT 'given', id, summary FROM mem WHERE id % 50 = 0 UNION ALL SELECT 'directory', s_suppkey, s_name FROM supplier UNION ALL SELECT 'context', NULL, 'what was said'""")
def selector_input(spark, sf):
    """All that a selector reads."""
    memories = X.memories(spark, sf)
    directory = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("gist"))
    return P.selector_input(S.pool_in_order(memories, "default", "all", None), directory, "what was said", memories.where("id % 50 = 0").select("id", "summary"))


@query("""SELECT 'default' AS owner, count(*) AS hits, 'a [redacted-sk] question' AS query, 'fast' AS mode, '{"deduped":3}' AS detail FROM documents""")
def recall_logged(spark, sf):
    return P.recall_log(X.memories(spark, sf), "a sk-abcdefghijklmnop1234 question", "fast", at(), "default", 3).select("owner", "hits", "query", "mode", "detail")


NUMBER = "CAST(reply_id AS VARCHAR) || '. '"


def said_sql(n: int) -> str:
    return clipped_sql(SQUEEZED, n)


@query(GISTED + f""", l AS (SELECT topic_id, reply_id, row_number() OVER (PARTITION BY topic_id ORDER BY reply_id DESC) AS n, {NUMBER} || {said_sql(4000)} AS v,
            {NUMBER} || CASE WHEN gist <> '' THEN gist ELSE '用户：' || {said_sql(300)} END AS g FROM g)
    , b AS (SELECT topic_id, sum(length(v)) + count(*) - 1 + 9 + CASE WHEN topic_id % 2 = 0 THEN 5 + length('topic ' || topic_id) ELSE 0 END AS fixed FROM l WHERE n <= 3 GROUP BY topic_id)
    , r AS (SELECT l.*, fixed + sum(CASE WHEN n <= 3 THEN 0 ELSE length(g) END) OVER (PARTITION BY topic_id ORDER BY n) AS used FROM l JOIN b USING (topic_id))
    , k AS (SELECT *, max(CASE WHEN n > 3 AND used + 20 > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id ORDER BY n) AS stop FROM r)
    SELECT topic_id, concat_ws(chr(10) || chr(10), CASE WHEN topic_id % 2 = 0 THEN '话题概要：topic ' || topic_id END, '最近用户轮原文：' || chr(10) || string_agg(v, chr(10) ORDER BY reply_id) FILTER (n <= 3),
        '逐轮纪要（新→旧）：' || chr(10) || string_agg(g, chr(10) ORDER BY reply_id DESC) FILTER (n > 3)) AS context FROM k WHERE stop = 0 GROUP BY topic_id""")
def context_texts(spark, sf):
    """Each topic's context as text."""
    summary = F.when(F.col("topic_id") % 2 == 0, F.concat(F.lit("topic "), F.col("topic_id").cast("string"))).otherwise("")
    return C.context_text(_gisted(spark, sf), summary, 900)


@query(REP + """ SELECT topic_id, reply_id, CASE WHEN answer <> '' AND reply_id % 2 = 0 THEN substr(answer, 1, 500) ELSE '' END AS gist FROM rep
    WHERE NOT (answer <> '' AND reply_id % 2 = 0) OR NOT regexp_matches(substr(answer, 1, 700), '[A-Za-z0-9]{4,}|[\\x{4e00}-\\x{9fff}]{2,}') OR TRUE""")
def set_gists(spark, sf):
    """New gists of some turns; one without a word of the turn isn't taken."""
    replies = X.replies(spark, sf).withColumn("gist", F.lit(""))
    even = replies.where("answer != ''").select("topic_id", "reply_id", F.when(F.col("reply_id") % 2 == 0, F.substring("answer", 1, 700)).otherwise("zzzzqqqq").alias("gist"))
    return C.set_gists(replies, even).select("topic_id", "reply_id", "gist")


@query("""WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user')
    , t AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 END AS topic_id FROM u GROUP BY conv_id)
    SELECT 'c' || u.conv_id AS conversation, n + CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 0 END AS reply_id, text AS query FROM u UNION ALL SELECT 'c' || conv_id, k, 'old' FROM t, (VALUES (1), (2), (3)) AS v(k) WHERE conv_id % 2 = 0""")
def logged_turns(spark, sf):
    """Turns of all conversations, of which half go on after three old ones."""
    turns = X.table(spark, sf, "conversations").where("role = 'user'")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    known = turns.where("conv_id % 2 = 0").select(name.alias("conversation"), (F.col("conv_id") + 1).alias("topic_id")).distinct()
    topics = conform(known, "topics")
    old = conform(known.select("topic_id", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("reply_id"), F.lit("old").alias("query")), "replies")
    added = turns.select(name.alias("conversation"), F.col("turn").alias("seq"), F.col("text").alias("query"), F.array().cast("array<string>").alias("injected"))
    replies, after = C.log_turns(old, topics, added, at())
    return replies.join(after.select("topic_id", "conversation"), "topic_id").select("conversation", "reply_id", "query")


@query(REP + """ SELECT topic_id, CASE WHEN topic_id % 3 = 0 THEN 'old' ELSE 'about ' || topic_id END AS summary, CASE WHEN topic_id % 3 = 0 THEN 1 ELSE max(reply_id) END AS summary_at FROM rep GROUP BY topic_id""")
def set_summaries(spark, sf):
    replies = X.replies(spark, sf)
    topics = conform(replies.select("topic_id").distinct().withColumns({"summary": F.lit("old"), "summary_at": F.lit(1)}), "topics")
    told = topics.select("topic_id", F.when(F.col("topic_id") % 3 > 0, F.concat(F.lit("about "), F.col("topic_id").cast("string"))).otherwise("").alias("summary"))
    return C.set_summaries(topics, told, replies).select("topic_id", "summary", "summary_at")


# ---- decisions -------------------------------------------------------------------------------

def _decide(step, rows):
    return J.RuleJudge().decide(step, rows)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS segment, TRUE AS worth FROM documents")
def decided_triage(spark, sf):
    return _decide("triage", X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).cast("long").alias("segment"), "text"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, 'fact' AS kind, substr(string_split(text, chr(10))[1], 1, 60) AS summary, substr(text, 1, 500) AS content, 'agent_inferred' AS origin, 0.5 AS confidence FROM documents".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"))
def decided_extract(spark, sf):
    rows = _decide("extract", X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).cast("long").alias("segment"), "text"))
    return rows.select("path", "kind", "summary", "content", "origin", "confidence")


@query(MEM + " SELECT id AS index, owner, content, confidence FROM mem")
def decided_verify(spark, sf):
    found = X.memories(spark, sf).withColumn("index", F.col("id"))
    return M.verified(found, _decide("verify", found)).select("index", "owner", "content", "confidence")


@query(MEM + " SELECT row_number() OVER (ORDER BY id) AS seq, 'NEW' AS action, owner, content, origin FROM mem")
def decided_merge(spark, sf):
    """Decisions as actions, numbered over the whole batch."""
    memories = X.memories(spark, sf).withColumns({"index": F.col("id"), "keywords": F.array("keywords"), "source": F.lit("x")})
    found = memories.select("index", "owner", "kind", "domain", "summary", "content", "keywords", "origin", "confidence", "source")
    decisions = D.durable(M.valid_decisions(_decide("merge", found), found, X.memories(spark, sf)))
    return M.sequenced(decisions, found, None).select("seq", "action", "owner", "content", "origin")


@query(MEM + f" SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS place FROM mem WHERE {OWN} ORDER BY id LIMIT 5")
def decided_pick(spark, sf):
    return in_order(P.deep_recall(X.memories(spark, sf), J.RuleJudge(), "q", as_of(), 5).memories.select("id"), "place")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, w.o AS \"offset\" FROM documents, LATERAL (SELECT unnest(range(0, length(text), 8000)) AS o) w WHERE length(text) > 0 AND length(trim(substr(text, CAST(w.o + 1 AS BIGINT), 8000), ' ')) >= 200")
def decided_inbox_filter(spark, sf):
    from anamnesis.sources import inbox as I

    texts = X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    windows = G.fixed_windows(texts, "path", "text")
    return I.kept_windows(windows, _decide("inbox-filter", windows), ["path", "offset"]).select("path", "offset")


@query(MEM + f" SELECT id, status, kind FROM mem")
def decided_reorganize(spark, sf):
    """Without a model nothing is reorganised: the store stays as it is."""
    memories = store_rows(spark, sf).withColumn("last_seen", F.to_date("last_seen_at"))
    plan = _decide("reorganize", S.owned(memories))
    merges = plan.where("op = 'merge'").select(F.col("place").alias("group_id"), "summary", "content", "keywords", "ids")
    changes, made, _ = U.reorganise(memories, merges, plan.where("op = 'conflict'").select("keep_id", "drop_id"), plan.where("op = 'archive'").select("id"), plan.where("op = 'retag'").select("id", "kind", "domain"), spark.createDataFrame([], TABLES["tombstones"]), "default", at())
    return U.reorganised(memories.drop("last_seen"), D.durable(changes), D.durable(made), at()).select("id", "status", "kind")


@query(MEM + f" SELECT kind || '/' || coalesce(domain, 'general') AS theme, count(*) AS members FROM mem WHERE owner = 'default' AND status = 'active' GROUP BY 1 HAVING count(*) >= 2")
def decided_clusters(spark, sf):
    memories = X.memories(spark, sf)
    return U.chapters(_decide("synthesize-cluster", S.owned(memories)), memories).select("theme", F.size("member_ids").cast("long").alias("members"))


@query("SELECT CAST(doc_id AS VARCHAR) AS theme, substr(string_split(text, chr(10))[1], 1, 60) AS abstract, substr(text, 1, 2000) AS content FROM documents")
def decided_themes(spark, sf):
    return _decide("synthesize-theme", X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("theme"), "text"))


@query(REP + rf" SELECT topic_id, reply_id, substr(regexp_replace(answer, '{BLANK}', ' ', 'g'), 1, 200) AS gist FROM rep WHERE answer <> ''")
def decided_gists(spark, sf):
    return _decide("reply-gist", X.replies(spark, sf).where("answer != ''"))


@query("SELECT conv_id AS topic_id, substr(regexp_replace(string_agg(text, chr(10) ORDER BY turn), '" + BLANK + "', ' ', 'g'), 1, 200) AS summary FROM conversations GROUP BY conv_id")
def decided_summaries(spark, sf):
    rows = X.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("topic_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return _decide("topic-summary", rows.select("topic_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")))


@query("SELECT 'default' AS owner, s_name AS domain, s_suppkey || ' memories, such as: ' || s_name AS card FROM supplier")
def decided_cards(spark, sf):
    return _decide("store-card", X.table(spark, sf, "supplier").select(F.lit("default").alias("owner"), F.col("s_name").alias("domain"), F.col("s_suppkey").alias("members"), F.col("s_name").alias("sample")))


@query(MEM + " SELECT id, 'ok' AS verdict, FALSE AS changed FROM mem")
def decided_audit(spark, sf):
    """Without a model all lessons are fine: each has its verdict, and none changes."""
    memories = X.memories(spark, sf)
    verdicts = _decide("audit", memories)
    changed = U.audited(memories, verdicts).select("id", F.lit(True).alias("changed"))
    return verdicts.join(changed, "id", "left").select("id", "verdict", F.coalesce("changed", F.lit(False)).alias("changed"))


@query(MEM + f" SELECT id, coalesce(domain, 'general') AS keywords, substr(summary, 1, 60) AS mini FROM mem WHERE {OWN}")
def decided_backfill(spark, sf):
    rows = S.owned(X.memories(spark, sf)).withColumns({"keywords": F.lit(""), "mini": F.lit(" ")})
    return U.backfilled(rows, _decide("backfill", rows))


@query(REQ + """ SELECT strftime(seen_at, '%Y-%m-%d') AS day, round(CAST(sum(req_bytes) AS DOUBLE) * 0.5 / 1e6 + CAST(sum(res_bytes) AS DOUBLE) * 2.0 / 1e6, 6) >= 0.01 AS broke FROM req WHERE step = 'view' GROUP BY 1""")
def money_left(spark, sf):
    """On which days a budget would have stopped the filter."""
    rows = X.requests(spark, sf).select("at", "step", F.col("req_bytes").alias("input_tokens"), F.col("res_bytes").alias("output_tokens"))
    return L.spend(rows, ("view",), 0.5, 2.0).select("day", (F.round("spent", 6) >= 0.01).alias("broke"))


# ---- a night, and streams --------------------------------------------------------------------

@query(rf"""WITH l AS (SELECT conv_id, turn, '[' || role || '] ' || {STRIPPED} AS line FROM conversations WHERE length({STRIPPED}) > 0),
        t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM l GROUP BY conv_id HAVING length(string_agg(line, chr(10) ORDER BY turn)) >= 300)
    SELECT 'fact' AS kind, substr(string_split(text, chr(10))[1], 1, 60) AS summary, substr(text, 1, 500) AS content, 'p' || conv_id AS source FROM t""")
def night_of_sessions(spark, sf):
    """A whole night over all conversations as session files, into an empty store."""
    record = message(type=F.lit("message"), message=F.struct("role", F.col("text").alias("content")))
    name = F.concat(F.lit("p"), F.col("conv_id").cast("string"))
    lines = X.table(spark, sf, "conversations").select(name.alias("path"), F.col("turn").alias("line_no"), record.alias("value"), F.lit("pi").alias("agent"))
    store = SnapshotStore(spark, scratch(spark, "night"))
    D.run(store, lines, J.RuleJudge(), at(), as_of())
    return store.read("memories").select("kind", "summary", "content", "source")


def _stream(spark, sf, rows, schema):
    folder = scratch(spark, "stream")
    rows.write.json(folder)
    return spark.readStream.schema(schema).json(folder)


def _ran(spark, stream, name, mode="append"):
    """What a stream over all files gives."""
    out, check = scratch(spark, name), scratch(spark, "checkpoint")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)
    stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT 'm' AS machine, CAST(user_id AS VARCHAR) AS uid, event_id AS line_no, event_type AS value FROM events UNION ALL SELECT 'm', CAST(user_id AS VARCHAR), event_id + 1000000, 'two words' FROM events")
def streamed_lines(spark, sf):
    """Lines that are pushed twice land once."""
    lines = F.array("event_type")
    rows = X.table(spark, sf, "events").select(F.lit("m").alias("machine"), F.lit("pi").alias("agent"), F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("from_line"), lines.alias("lines"), F.col("ts").cast("timestamp").alias("at"))
    # sessions of their own, as the places of the first ones may be a million apart too
    more = rows.withColumns({"uid": F.concat("uid", F.lit(":more")), "from_line": F.col("from_line") + 1_000_000, "lines": F.array(F.lit("two\nwords"))})
    folder, out, check = (scratch(spark, n) for n in ("pushes", "landed", "checkpoint"))
    rows.unionByName(rows).unionByName(more).write.json(folder)
    live.land(live.pushes(spark, folder), out, check).awaitTermination()
    return spark.read.parquet(out).select("machine", F.split("uid", ":")[0].alias("uid"), "line_no", "value")


@query("SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS conversation, event_type AS item FROM events")
def streamed_ledger(spark, sf):
    """In a stream's watermark each item of a conversation comes once."""
    rows = X.table(spark, sf, "events").select((F.col("user_id") % 40).cast("string").alias("conversation"), F.col("event_type").alias("item"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    stream = _stream(spark, sf, rows, "conversation string, item string, at timestamp")
    return _ran(spark, live.fresh_injections(stream), "ledger").select("conversation", "item")


@query(REQ + " SELECT strftime(seen_at, '%Y-%m-%d') AS day, category, count(*) AS n, CAST(sum(req_bytes) AS BIGINT) AS req_bytes FROM req GROUP BY 1, 2")
def streamed_activity(spark, sf):
    rows = X.requests(spark, sf).select(F.col("at").cast("timestamp").alias("at"), "category", "req_bytes")
    stream = _stream(spark, sf, rows, "at timestamp, category string, req_bytes long")
    return _ran(spark, live.live_activity(stream), "activity", "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "category", "n", "req_bytes")


@query("SELECT CAST(user_id % 40 AS VARCHAR) AS conversation, event_type AS item FROM events WHERE user_id % 40 <> 7 GROUP BY 1, 2")
def cleared_ledger(spark, sf):
    """A conversation that was compacted is forgotten."""
    rows = X.table(spark, sf, "events").select((F.col("user_id") % 40).cast("string").alias("conversation"), F.col("event_type").alias("item"), F.col("ts").alias("injected_at"))
    ledger = C.log_injections(rows.limit(0), rows, F.lit("2024-01-20").cast("timestamp_ntz"))
    return C.clear_injections(ledger, "7").select("conversation", "item")


@query("SELECT CAST(user_id % 40 AS VARCHAR) AS conversation, event_type AS item, CASE WHEN user_id % 40 = 7 THEN 2 ELSE 1 END AS times FROM events GROUP BY 1, 2, 3")
def streamed_resets(spark, sf):
    """A stream of items and resets: after its conversation's reset an item counts as fresh again."""
    rows = X.table(spark, sf, "events").select((F.col("user_id") % 40).cast("string").alias("conversation"), F.col("event_type").alias("item")).distinct()
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    step = lambda n: start + F.make_dt_interval(mins=F.lit(n))
    seven = rows.where("conversation = '7'")
    reset = seven.select("conversation").distinct().select("conversation", F.lit(None).cast("string").alias("item"), step(2).alias("at"), F.lit(True).alias("reset"))
    events = rows.withColumns({"at": step(0), "reset": F.lit(False)}).unionByName(rows.withColumns({"at": step(1), "reset": F.lit(False)})).unionByName(reset).unionByName(seven.withColumns({"at": step(3), "reset": F.lit(False)}))
    return _freshened(spark, sf, events, "resets").groupBy("conversation", "item").agg(F.count("*").alias("times"))


def _freshened(spark, sf, events, name):
    """``fresh_with_resets`` over events as files."""
    with _state_store(spark):
        stream = _stream(spark, sf, events, "conversation string, item string, at timestamp, reset boolean")
        return _ran(spark, live.fresh_with_resets(stream), name)


@contextmanager
def _state_store(spark):
    """The state store that map state and timers need; the session's own is restored."""
    key, store = live.STATE_STORE
    own = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, own)


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS c, event_type AS i, user_id % 40 = 7 AND ts >= TIMESTAMP '2024-01-15' AS later, epoch_us(ts) // 1000 AS t FROM events),
    f AS (SELECT c, i, later, min(t) AS t FROM e GROUP BY ALL
        UNION ALL SELECT f.c, f.i, f.later, min(e.t) FROM f JOIN e ON e.c = f.c AND e.i = f.i AND e.later = f.later AND e.t > f.t + 172800000 GROUP BY f.c, f.i, f.later, f.t)
    SELECT c AS conversation, i AS item, count(*) AS times, max(t) AS last_ms FROM f GROUP BY c, i""")
def streamed_expiry(spark, sf):
    """Items over a month: each is fresh again after 48 hours, and at once after its conversation's compaction."""
    events = X.table(spark, sf, "events").select((F.col("user_id") % 40).cast("string").alias("conversation"), F.col("event_type").alias("item"), F.col("ts").cast("timestamp").alias("at"), F.lit(False).alias("reset"))
    compacted = events.where("conversation = '7'").select("conversation").distinct()
    compacted = compacted.select("conversation", F.lit(None).cast("string").alias("item"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("at"), F.lit(True).alias("reset"))
    fresh = _freshened(spark, sf, events.unionByName(compacted), "expiry")
    return fresh.groupBy("conversation", "item").agg(F.count("*").alias("times"), F.unix_millis(F.max("at")).alias("last_ms"))


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations)
    SELECT 'c' || conv_id AS uid, 0 AS generation, n AS line_no, replace(text, chr(10), ' ') AS value, NULL AS note FROM c WHERE conv_id % 3 <> 1 OR n = 0
    UNION ALL SELECT 'c' || conv_id, 1, n, replace(text, chr(10), ' ') || '!', NULL FROM c WHERE conv_id % 3 = 2
    UNION ALL SELECT 'c' || conv_id, 1, 0, NULL, 'restart' FROM c WHERE conv_id % 3 = 2 AND n = 0
    UNION ALL SELECT 'c' || conv_id, 0, 1, NULL, 'gap' FROM c WHERE conv_id % 3 = 1 AND n >= 2""")
def streamed_pushes(spark, sf):
    """Each turn of a conversation as a push, twice. Of a third of the conversations the second turn never comes, so all later ones
    are gaps; another third is written anew with other words."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    value = F.replace("text", F.lit("\n"), F.lit(" "))
    turns = X.table(spark, sf, "conversations").select("conv_id", place.cast("long").alias("from_line"), F.array(value).alias("lines"))
    kept = turns.where("conv_id % 3 != 1 OR from_line != 1")
    again = kept.where("conv_id % 3 != 1 OR from_line = 0")
    anew = turns.where("conv_id % 3 = 2").withColumn("lines", F.array(F.concat(F.get("lines", F.lit(0)), F.lit("!"))))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    pushed = None
    for day, part in enumerate((kept, again, anew)):
        rows = part.withColumn("at", start + F.make_dt_interval(days=F.lit(day)))
        pushed = rows if pushed is None else pushed.unionByName(rows)
    rows = pushed.select(F.lit("m").alias("machine"), F.lit("pi").alias("agent"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("uid"), "from_line", "lines", "at")
    with _state_store(spark):
        return _ran(spark, live.aligned(_stream(spark, sf, rows, live.PUSH)), "pushes").select("uid", "generation", "line_no", "value", "note")
