"""Tables of the memory store, their defaults, and migrations between versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1
KINDS = ("preference", "fact", "knowledge", "lesson", "skill_index")
ORIGINS = ("user_stated", "agent_inferred", "mixed")
STATUSES = ("active", "absorbed", "superseded", "archived")
PERSONAL_KINDS = ("preference", "fact", "knowledge")

# Tables and columns by name, as other programs know them.
TABLES = {
    "memories": "id long, owner string, cwd string, kind string, domain string, summary string, mini string,"
    " content string, keywords string, origin string, confidence double, evidence long, source string, pinned int,"
    " status string, superseded_by long, absorbed_by long, created_at timestamp, updated_at timestamp, last_seen_at timestamp",
    "profiles": "id long, owner string, theme string, title string, abstract string, content string,"
    " memory_ids array<long>, maturity string, status string, version long, parent_id long, created_at timestamp,"
    " updated_at timestamp",
    "tombstones": "digest string, owner string, reason string, source_id long, created_at timestamp",
    "topics": "topic_id long, conversation string, first_reply string, summary string, summary_at long,"
    " first_seen_at timestamp, last_seen_at timestamp",
    "replies": "topic_id long, reply_id long, query string, injected array<string>, answer string, gist string, created_at timestamp",
    "injection_log": "conversation string, item string, injected_at timestamp, mark long",
    "distill_state": "session_file string, processed_bytes long, gist string, processed_at timestamp",
    "session_registry": "session_uid string, agent string, machine string, path string, bytes long, updated_at timestamp",
    "inbox_files": "id long, path string, content_hash string, format string, raw_bytes long, slim_chars long,"
    " status string, lens_offsets map<string,long>, filter_stats map<string,long>, error string, created_at timestamp,"
    " updated_at timestamp",
    "slot_demands": "id long, owner string, domain string, demand_count long, last_demand_at timestamp",
    "token_log": "id long, at timestamp, run_id string, step string, session_file string, model string,"
    " input_tokens long, output_tokens long, latency_ms long",
    "recall_log": "id long, at timestamp, owner string, query string, mode string, hits long, latency_ms long, detail string",
    "request_log": "id long, at timestamp, category string, route string, client string, req_bytes long, res_bytes long, ms long",
    "memory_log": "id long, at timestamp, run_id string, action string, detail string",
    "kv": "key string, value string",
    # the index of texts (see plans/index.py)
    "postings": "gram long, id long, places array<int>, mark long",
    "sizes": "id long, size long, mark long",
}

DEFAULTS = {
    "memories": {"owner": "default", "mini": "", "keywords": "", "origin": "agent_inferred", "confidence": 0.5, "evidence": 1, "pinned": 0, "status": "active"},
    "profiles": {"abstract": "", "maturity": "mature", "status": "active", "version": 1},
    "topics": {"summary": "", "summary_at": 0},
    "replies": {"answer": "", "gist": ""},
    "slot_demands": {"demand_count": 1},
    "request_log": {"client": "", "req_bytes": 0, "res_bytes": 0, "ms": 0},
    "distill_state": {"processed_bytes": 0, "gist": ""},
    "inbox_files": {"status": "pending"},
    "injection_log": {"mark": 0},
    "recall_log": {"mode": "deep", "hits": 0, "latency_ms": 0},
    "token_log": {"latency_ms": 0},
}


def fields(table: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns."""
    parts = re.split(r",\s*(?![^<]*>)", TABLES[table])
    return [tuple(p.split(" ", 1)) for p in parts]


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns: missing ones get defaults, nulls too where there
    is a default, and types are cast. This also lifts rows of older versions."""
    have, defaults = {c.lower() for c in df.columns}, DEFAULTS.get(table, {})
    out = []
    for name, kind in fields(table):
        value = F.col(f"`{name}`") if name in have else F.lit(None)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)
