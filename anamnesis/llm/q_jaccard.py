"""Query of the n-gram Jaccard join, and SQL that compares all pairs which share an element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import table
from anamnesis.llm.jaccard import jaccard_classes


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] WHEN len(ws) = 0 THEN ['=' || text]
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS es FROM w),
e AS (SELECT doc_id, len(es) AS n, unnest(es) AS el FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j
      FROM e a JOIN e b ON a.el = b.el AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y, j FROM p WHERE j >= 0.8 - 1e-12),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
copy AS (SELECT x, min(y) AS c FROM link WHERE j = 1 GROUP BY x),
num AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(c, d.doc_id)) AS copy_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM documents d JOIN class ON class.x = d.doc_id LEFT JOIN copy ON copy.x = d.doc_id LEFT JOIN num ON num.x = d.doc_id
"""
