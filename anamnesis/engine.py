"""The store as one object: ask, write, curate and report."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.deploy import durable, ship
from anamnesis.operators import conversations, selection, upkeep, usage
from anamnesis.operators.merging import tombstones_of
from anamnesis.plans import dream, index, ingest, pick, recall
from anamnesis.plans.judge import Judge, RuleJudge
from anamnesis.schema import TABLES, conform
from anamnesis.snapshots import SnapshotStore

MOST_K, MOST_DAYS = 20, 90


class MemoryEngine:
    """A store below ``root``. Times are arguments, so every call can be repeated; ``now`` is the
    default for all of them."""

    def __init__(self, spark: SparkSession, root: str, judge: Judge | None = None, now: Column | None = None, keep: int = 7):
        self.spark, self.store, self.judge = ship(spark), SnapshotStore(spark, root, keep), judge or RuleJudge()
        self._now = now

    @property
    def now(self) -> Column:
        """The time given, or else the current one, as a value that all jobs of a call share."""
        return self._now if self._now is not None else F.lit(datetime.now(UTC))

    def memories(self) -> DataFrame:
        return self.store.read("memories").withColumn("last_seen", F.to_date("last_seen_at"))

    def _ledger(self, conversation: str | None) -> DataFrame | None:
        if conversation is None:
            return None
        return conversations.standing_injections(self.store.read("injection_log").where(F.col("conversation") == conversation), self.now)

    def recalled(self, query: str, k: int = 5, owner: str = "default", scope: str = "smart", cwd: str | None = None, mode: str = "deep", conversation: str | None = None) -> pick.Recalled:
        """The memories for a question, in order, with the chapters that a selector chose. In a conversation each
        memory is given once within 48 hours; every question is logged."""
        k, ledger, today = selection.clamp(k, 1, MOST_K), self._ledger(conversation), F.to_date(self.now)
        if mode == "deep":
            found = pick.deep_recall(self.memories(), self.judge, query, today, k, owner, scope, cwd, ledger, self.store.read("profiles"))
        else:
            store = self.store
            found_by = index.open_index(store.read("postings"), store.read("sizes"), store.read("memories"))
            rows = recall.fast_recall(self.memories(), query, today, k, owner, scope, cwd, mode == "excavate", ledger, found_by)
            had = 0 if ledger is None else ledger.where(F.col("item").startswith("m:")).count()
            found = pick.Recalled(rows, self.store.read("profiles").limit(0), had)
        # at most twenty rows, which keep their order; what is given must be what is logged
        rows = found.memories.collect()
        found.memories = self.spark.createDataFrame(rows, found.memories.schema)
        log = pick.recall_log(found.memories, query, mode, self.now, owner, found.deduped)
        self.store.log("recall_log", log)
        if conversation is not None and rows:
            given = self.spark.createDataFrame([(conversation, f"m:{r.id}") for r in rows], "conversation string, item string")
            self.store.log("injection_log", given.withColumns({"injected_at": self.now, "mark": F.lit(time.time_ns())}))
        return found

    def recall(self, query: str, k: int = 5, **rest: object) -> DataFrame:
        """The memories of ``recalled``."""
        return self.recalled(query, k, **rest).memories

    def context(self, conversation: str, budget: int = conversations.CONTEXT_CHARS) -> str:
        """A conversation's topic as text: its summary, last turns, and a line for each earlier one."""
        topic = self.store.read("topics").where(F.col("conversation") == conversation)
        replies = self.store.read("replies").join(topic.select("topic_id", "summary"), "topic_id")
        row = conversations.context_text(replies, F.col("summary"), budget).first()
        return row.context if row else ""

    def say(self, conversation: str, query: str, answer: str | None = None) -> None:
        """Log a turn of a conversation, and its answer; only the conversation's rows are written."""
        base, now = self.store.newest(), self.now
        known = self.store.read("topics")
        added = self.spark.createDataFrame([(conversation, 1, query, [])], "conversation string, seq long, query string, injected array<string>")
        before = self.store.read("replies").join(F.broadcast(known.where(F.col("conversation") == conversation).select("topic_id")), "topic_id", "left_semi")
        replies, topics = conversations.log_turns(before, known, added, now)
        mine = durable(topics.where(F.col("conversation") == conversation))
        if answer is not None:
            replies = conversations.attach_answers(replies, mine.select("topic_id", F.lit(1).alias("seq"), F.lit(answer).alias("answer")))
        self.store.commit({}, base=base, touched={"replies": replies.exceptAll(before), "topics": mine})

    def probe(self, owner: str = "default", scope: str = "smart", cwd: str | None = None) -> DataFrame:
        return pick.probe(self.memories(), self.judge, owner, scope, cwd, self.store.read("profiles"))

    def audit(self, owner: str = "default", dry_run: bool = True) -> DataFrame:
        """The trail of an audit of lessons; what it says is done unless it is a dry run."""
        base, now = self.store.newest(), self.now
        memories = self.memories()
        lessons = selection.owned(memories, owner).join(upkeep.audit_batches(memories, owner), "id")
        verdicts = durable(self.judge.decide("audit", lessons))
        trail = durable(upkeep.audit_trail(memories, verdicts))
        if not dry_run:
            after = upkeep.changed(self.store.read("memories"), upkeep.audited(memories, verdicts), now)
            entry = trail.select(now.alias("at"), F.concat(F.lit("audit "), "verdict").alias("action"), F.to_json(F.struct("id", "before", "after")).alias("detail"))
            self._touch(after.where(F.col("updated_at") >= now), base, {"memory_log": entry})
        return trail

    def backfill(self, owner: str = "default") -> int:
        """Keywords and handles for memories without them; returns how many rows were changed."""
        base, now = self.store.newest(), self.now
        memories = self.store.read("memories")
        bare = selection.owned(memories, owner).where("trim(keywords) = '' OR trim(mini) = ''")
        batches = bare.join(upkeep.backfill_batches(memories.withColumn("_any", F.when((F.trim("keywords") != "") & (F.trim("mini") != ""), "x").otherwise("")), "_any", owner=owner), "id")
        found = durable(upkeep.backfilled(bare, durable(self.judge.decide("backfill", batches))))
        after = durable(upkeep.changed(memories, found, now))
        self._touch(after.where(F.col("updated_at") >= now), base)
        return found.count()

    def inject(self, owner: str = "default", scope: str = "smart", cwd: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Pinned memories and the directory of chapters."""
        return selection.constitution(self.memories(), owner, scope, cwd), selection.profile_directory(self.store.read("profiles"), owner)

    def list(self, owner: str = "default", status: str = "active", limit: int = 100) -> DataFrame:
        return selection.list_memories(self.memories(), owner, status, limit)

    def counts(self, owner: str | None = None) -> DataFrame:
        return selection.counts_by_status(self.store.read("memories"), owner)

    def remember(self, owner: str = "default", cwd: str | None = None, **candidate) -> DataFrame:
        """Write one memory (``summary``, ``content`` and more of a candidate's fields); returns the log."""
        base, now = self.store.newest(), self.now
        full = {"kind": "fact", "origin": "user_stated", "confidence": 0.9, "keywords": []} | candidate
        return self._write(ingest.remember(self.store.read("memories"), self.store.read("tombstones"), self.judge, full, now, owner, cwd), base, now)

    def ingest(self, text: str, source: str, owner: str = "default") -> DataFrame:
        base, now = self.store.newest(), self.now
        return self._write(ingest.ingest_text(self.store.read("memories"), self.store.read("tombstones"), self.judge, text, source, now, owner), base, now)

    def _write(self, out: ingest.Written, base: int, now: Column) -> DataFrame:
        """New rows are appended; of other changes the rows that they touch are written, unless another writer came
        after version ``base``. The index gets the same rows."""
        if out.added is not None:
            self.store.append({"memories": out.added} | index.entries(out.added))
        else:
            self._touch(out.memories.where(F.col("updated_at") >= now), base)
        return out.log

    def _touch(self, rows: DataFrame, base: int, added: dict[str, DataFrame] | None = None) -> int:
        """Write changed rows of the memories, and their entries in the index."""
        rows = durable(rows)
        return self.store.commit({}, index.entries(rows) | (added or {}), base, {"memories": rows})

    def reindex(self) -> int:
        """Build the index anew, for a store that was written without."""
        return self.store.commit(index.entries(self.store.read("memories")))

    def forget(self, ids: list[int], reason: str = "forgotten") -> int:
        """Archive memories and keep their contents from coming back; returns the new version."""
        base = self.store.newest()
        chosen = self.spark.createDataFrame([(i,) for i in ids], "id long")
        after, stones = upkeep.archive(self.store.read("memories").where(F.col("id").isin(ids)), chosen, reason, self.now)
        fresh = stones.join(self.store.read("tombstones").select("owner", "digest"), ["owner", "digest"], "left_anti")
        return self.store.commit({}, {"tombstones": fresh.dropDuplicates(["owner", "digest"])}, base, {"memories": after})

    def pin(self, ids: list[int], pinned: bool = True) -> int:
        base = self.store.newest()
        rows = self.store.read("memories").where(F.col("id").isin(ids))
        return self.store.commit({}, base=base, touched={"memories": rows.withColumn("pinned", F.lit(int(pinned)))})

    def clear(self, conversation: str) -> None:
        """Forget what a conversation was given."""
        cleared = self.spark.createDataFrame([(conversation, None, time.time_ns())], "conversation string, item string, mark long")
        self.store.log("injection_log", cleared.withColumn("injected_at", self.now))

    def decay(self) -> DataFrame:
        return upkeep.decayed(self.memories(), F.to_date(self.now))

    def dream(self, lines: DataFrame, owner: str = "default", **rest: object) -> dict[str, int]:
        return dream.run(self.store, lines, self.judge, self.now, F.to_date(self.now), owner, **rest)

    def activity(self, days: int = 7) -> DataFrame:
        return usage.activity(self.store.read("request_log"), self._since(days))

    def token_usage(self, days: int = 7) -> DataFrame:
        return usage.token_usage(self.store.read("token_log"), self._since(days))

    def _since(self, days: int) -> Column:
        return self.now - F.make_dt_interval(days=F.lit(selection.clamp(days, 1, MOST_DAYS)))

    def restore(self, version: int) -> int:
        """Make an older version the newest."""
        return self.store.commit({t: self.store.read(t, version) for t in TABLES if t in self.store.manifest(version)["tables"]})

    def tombstone(self, contents: list[str], owner: str = "default") -> int:
        base = self.store.newest()
        rows = self.spark.createDataFrame([(None, owner, c) for c in contents], "id long, owner string, content string")
        old = self.store.read("tombstones")
        stones = tombstones_of(rows, "stated", self.now).select(*old.columns)
        return self.store.commit({"tombstones": old.unionByName(stones).dropDuplicates(["owner", "digest"])}, base=base)
