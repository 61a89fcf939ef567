"""The jobs as queries over whole tables, with SQL that gives the same rows.

Each runs its job twice into one new folder below the shared one, and reads back what stands there then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from anamnesis.deploy import shared_folder
from anamnesis.functions import text as T
from jobs import knowledge, transcripts

BLANKS = T.BLANKS


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANKS}|{BLANKS}$', '', 'g')"


def _kept(text: str) -> str:
    """Without cards, images, code, keys."""
    lines = f"list_filter(string_split({text}, chr(10)), lambda l: NOT regexp_matches({_stripped('l')}, '{'|'.join(f'(?:{p})' for p in T.ENVELOPE_LINES)}'))"
    hints = " OR ".join(f"contains({text}, '{h}')" for h in T.ENVELOPE_HINTS)
    text = f"CASE WHEN {hints} THEN array_to_string({lines}, chr(10)) ELSE {text} END"
    # RE2 repeats at most a thousand times, and has no white space beyond ASCII in its class
    return _stripped(f"regexp_replace(regexp_replace({text}, '{T.INLINE_IMAGE}', '{T.IMAGE_MARK}', 'g'), '{T.CODE_FENCE}', '{T.CODE_MARK}', 'g')")


def _scrubbed(text: str) -> str:
    for pattern, mark in T.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return rf"regexp_replace({text}, '(access ?key(?: ?secret)?(?:是|=|:)\s*)[A-Za-z0-9]{{24,40}}(\s|$)', '\1[redacted-key]\2', 'gim')"


def _digest(text: str) -> str:
    return f"sha256(regexp_replace(lower(nfc_normalize({text})), '{T.FOLDED}', '', 'g'))"


def _clipped(text: str, size: int) -> str:
    return f"CASE WHEN length({text}) > {size} THEN substr({text}, 1, {size}) || '…' ELSE {text} END"


def _squeezed(text: str) -> str:
    return f"regexp_replace({text}, '{BLANKS}', ' ', 'g')"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    for _ in range(2):
        transcripts.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/output", f"{folder}/checkpoint", buckets=8)
    return transcripts.read(spark, f"{folder}/output")


JOB1_SQL = f"""
WITH c AS (SELECT conv_id, turn, lower(role) AS role, {_kept("coalesce(text, '')")} AS cleaned FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT conv_id, turn, role, {_scrubbed("cleaned")} AS text, cleaned FROM c),
t AS (SELECT conv_id, turn, role, text, {_digest("text")} AS digest, text <> cleaned AS redacted FROM s
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text DESC, role DESC) = 1),
u AS (SELECT conv_id, turn, text AS query, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t WHERE role = 'user' AND text <> ''),
l AS (SELECT conv_id, turn, n, turn || '. ' || {_clipped(_squeezed("query"), 4000)} AS v, turn || '. 用户：' || {_clipped(_squeezed("query"), 300)} AS g FROM u),
b AS (SELECT conv_id, sum(length(v)) + count(*) - 1 + 9 AS fixed FROM l WHERE n <= 3 GROUP BY conv_id),
r AS (SELECT l.*, fixed + sum(CASE WHEN n <= 3 THEN 0 ELSE length(g) END) OVER (PARTITION BY l.conv_id ORDER BY n) AS used FROM l JOIN b ON l.conv_id = b.conv_id),
k AS (SELECT *, max(CASE WHEN n > 3 AND used + 20 > 32000 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS stop FROM r),
x AS (SELECT conv_id, concat_ws(chr(10) || chr(10), '最近用户轮原文：' || chr(10) || string_agg(v, chr(10) ORDER BY turn) FILTER (n <= 3),
    '逐轮纪要（新→旧）：' || chr(10) || string_agg(g, chr(10) ORDER BY turn DESC) FILTER (n > 3)) AS context FROM k WHERE stop = 0 GROUP BY conv_id),
n AS (SELECT conv_id, count(*) FILTER (text <> '') AS n_turns, count(*) FILTER (text <> '' AND role = 'user') AS user_turns,
    CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (redacted) AS n_redacted FROM t GROUP BY conv_id)
SELECT t.conv_id, turn, role, text, digest, redacted, n_turns, user_turns, chars, n_redacted, context FROM t JOIN n ON t.conv_id = n.conv_id LEFT JOIN x ON t.conv_id = x.conv_id
"""


def job2_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):
        knowledge.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    return knowledge.read(spark, folder)


JOB2_SQL = f"""
WITH c AS (SELECT doc_id AS id, lang, source, {_kept("coalesce(text, '')")} AS cleaned FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT id, lang, source, {_scrubbed("cleaned")} AS content FROM c),
d AS (SELECT *, {_digest("content")} AS digest FROM s WHERE content <> ''),
o AS (SELECT doc_id AS id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT digest, count(*) AS documents, min(d.id) AS id, count(DISTINCT source) AS sources, max(coalesce(toxic, 0)) AS toxic FROM d LEFT JOIN o ON d.id = o.id GROUP BY digest),
m AS (SELECT g.id, g.digest, least(documents, 100) AS evidence, sources, min(lang) AS domain, min(source) AS source, min(content) AS content,
    CASE any_value(quality) WHEN 1 THEN 0.9 WHEN 0 THEN 0.3 ELSE 0.5 END AS confidence
    FROM g JOIN d ON d.id = g.id AND d.digest = g.digest LEFT JOIN o ON o.id = g.id WHERE g.toxic = 0 GROUP BY g.id, g.digest, documents, sources),
k AS (SELECT domain, count(*) AS n, CAST(sum(evidence) AS BIGINT) AS ev, CAST(sum(CAST(CAST('0x' || substr(digest, 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS h FROM m GROUP BY domain)
SELECT 'memory' AS part, id, m.domain, source, {_clipped(_squeezed("regexp_extract(content, '^[^' || chr(10) || ']*')"), 60)} AS summary, content, digest, evidence, sources,
    CAST(confidence AS DOUBLE) AS confidence, n AS in_domain, ev AS domain_evidence, h AS domain_hash FROM m JOIN k ON m.domain IS NOT DISTINCT FROM k.domain
UNION ALL SELECT 'tombstone', NULL, NULL, NULL, NULL, NULL, digest, documents, NULL, NULL, NULL, NULL, NULL FROM g WHERE toxic <> 0
"""

QUERIES = {f.__name__: f for f in (job1_transcripts, job2_knowledge)}
ORACLES = {"job1_transcripts": JOB1_SQL, "job2_knowledge": JOB2_SQL}
