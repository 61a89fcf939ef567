"""Query of sharding, and SQL that schedules group by group. Both number groups of a size, and rows of
a shard, in one cell, as long as there are no more than twenty thousand. Tests check the law, the groups and the
slots on others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import table
from anamnesis.llm.sharding import shard_by_bytes

SHARDS = 40


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_STEP = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: {_STEP}) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, substr(sha256(CASE WHEN text IS NULL THEN 'null' ELSE '=' || text END), 1, 32) AS grp FROM documents),
r AS (SELECT doc_id, grp, octet_length(b) + 16 AS size, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(b)), lambda i: CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT))),
        lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM d, crc),
g AS (SELECT grp, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY grp),
items AS (SELECT bytes, row_number() OVER (ORDER BY bytes DESC) AS n FROM g),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS p, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)) AS loads
    UNION ALL SELECT items.n, items.bytes, CAST(lo AS BIGINT), list_transform(loads, lambda x, i: CASE WHEN i = lo THEN x + items.bytes ELSE x END)
    FROM (SELECT *, list_position(loads, list_min(loads)) AS lo FROM f) f JOIN items ON items.n = f.n + 1),
place AS (SELECT bytes, p - 1 AS shard, row_number() OVER (PARTITION BY bytes ORDER BY p) AS k FROM f WHERE n > 0),
named AS (SELECT grp, bytes, row_number() OVER (PARTITION BY bytes ORDER BY grp) AS k FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM r JOIN named USING (grp) JOIN place USING (bytes, k)
"""
