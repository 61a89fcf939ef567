"""The driver's tables in the roles of the store's tables, and the same views in DuckDB SQL.

The formulas are stand-ins for tests and benchmarks; each has one form for both engines.
"""

from __future__ import annotations

import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.deploy import ship

AS_OF = "2024-07-01"

_MEMORIES = """
    SELECT doc_id + 1 AS id,
        CASE WHEN doc_id % 13 < 10 THEN 'default' ELSE 'team' END AS owner,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('/p/', source) END AS cwd,
        CASE doc_id % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'fact' WHEN 2 THEN 'knowledge' WHEN 3 THEN 'lesson'
            ELSE 'skill_index' END AS kind,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS domain,
        substr(text, 1, 60) AS summary, '' AS mini, text AS content, concat(lang, ' ', source) AS keywords,
        CASE doc_id % 3 WHEN 0 THEN 'user_stated' WHEN 1 THEN 'agent_inferred' ELSE 'mixed' END AS origin,
        CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS confidence,
        1 + doc_id % 7 AS evidence,
        CAST(CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS INT) AS pinned,
        CASE WHEN doc_id % 20 < 15 THEN 'active' WHEN doc_id % 20 < 17 THEN 'absorbed'
            WHEN doc_id % 20 < 18 THEN 'superseded' ELSE 'archived' END AS status,
        {day} AS last_seen
    FROM {documents}
"""
_REPLIES = """
    SELECT u.conv_id AS topic_id, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS reply_id,
        u.text AS query, coalesce(a.text, '') AS answer, u.turn AS turn
    FROM {conversations} u LEFT JOIN {conversations} a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'
"""
_REQUESTS = """
    SELECT event_id AS id, ts AS seen_at,
        CASE event_type WHEN 'view' THEN 'recall' WHEN 'click' THEN 'probe' WHEN 'purchase' THEN 'remember'
            WHEN 'signup' THEN 'inject' ELSE 'other' END AS category,
        CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('u', CAST(user_id AS {string})) END AS client,
        CAST(floor(value * 10) AS BIGINT) AS req_bytes,
        CAST(length(props) AS BIGINT) AS res_bytes,
        event_id % 100 AS ms, event_type AS step, user_id
    FROM {events}
"""


def _spark(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    day = "date_add(DATE '2024-01-01', CAST(doc_id * 7 % 180 AS INT))"
    return spark.sql(sql.format(**{name: "{source}"}, day=day, string="STRING"), source=table(spark, sf_dir, name))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as memories, with a date ``last_seen``."""
    return _spark(spark, sf_dir, _MEMORIES, "documents")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` with the assistant's answers."""
    return _spark(spark, sf_dir, _REPLIES, "conversations")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of requests and tokens."""
    return _spark(spark, sf_dir, _REQUESTS, "events").withColumnRenamed("seen_at", "at")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` of files that hold ten documents each, by turns as zip, tar.gz, or the first alone."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") / 10).cast("long").alias("file"), "doc_id", "text")

    def packed(group: pa.Table) -> pa.Table:
        number, out = group["file"][0].as_py(), io.BytesIO()
        docs = sorted(zip(group["doc_id"].to_pylist(), group["text"].to_pylist()))
        files = [(f"d{i}.{'png' if i % 4 == 3 else 'md'}", (t or "").encode()) for i, t in docs]
        if number % 3 == 0:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if number % 2 else zipfile.ZIP_STORED) as z:
                for name, data in files:
                    z.writestr(name, data)
        elif number % 3 == 1:
            with tarfile.open(fileobj=out, mode="w:gz", format=tarfile.USTAR_FORMAT) as t:
                for name, data in files:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        else:
            out.write(files[0][1])
        return pa.table({"path": [f"drops/f{number}{'' if number % 3 == 2 else '.pack'}"], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy("file").applyInArrow(packed, "path string, content binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


MEMORIES_SQL = _MEMORIES.format(day="DATE '2024-01-01' + CAST(doc_id * 7 % 180 AS INT)", documents="documents")
REPLIES_SQL = _REPLIES.format(conversations="conversations")
REQUESTS_SQL = _REQUESTS.format(events="events", string="VARCHAR")
