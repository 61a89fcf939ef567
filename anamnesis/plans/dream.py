"""The nightly run: from new session lines and dropped files to a new version of the store.

Steps change tables of a ``Night``; at its end all changed tables become one new version. A step's
tables are checkpointed, so that a judge is asked once and plans stay small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.deploy import durable
from anamnesis.operators import conversations, upkeep
from anamnesis.operators.merging import apply_actions, sequenced, valid_decisions, verified
from anamnesis.operators.segments import fixed_windows, greedy_segments, resume_at, segment_texts, within_budget
from anamnesis.operators.selection import material, owned, owners, wanted
from anamnesis.operators.usage import spend
from anamnesis.plans import index
from anamnesis.plans.judge import Judge
from anamnesis.plans.pick import latest_by_owner
from anamnesis.schema import conform
from anamnesis.snapshots import SnapshotStore
from anamnesis.sources import inbox, sinks
from anamnesis.sources.sessions import parse, registered

SEGMENT_CHARS, LEAST_SEGMENT = 30_000, 300
INBOX_CHARS, FILTER_STEPS = 2_000_000, ("inbox-filter",)
WEEK, LISTED_CHARS, LIVE_DAYS, LENS = 7, 400, 3, "default"
CARD = "card:"


@dataclass
class Night:
    """A run: the store, the judge, the time, and the tables as they are by now."""

    store: SnapshotStore
    judge: Judge
    at: Column
    as_of: Column
    owner: str = "default"
    daily_budget: float | None = None
    prices: tuple[float, float] = (0.0, 0.0)
    on_actions: Callable[[DataFrame], None] | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    log: list[tuple[str, str]] = field(default_factory=list)

    def get(self, table: str) -> DataFrame:
        return self.tables[table] if table in self.tables else self.store.read(table)

    def put(self, table: str, df: DataFrame) -> None:
        self.tables[table] = durable(conform(df, table))

    def memories(self) -> DataFrame:
        return self.get("memories").withColumn("last_seen", F.to_date("last_seen_at"))

    def owners(self) -> list[str]:
        """The owners of one store are the agents and people it serves, so they are few."""
        return sorted(r.owner for r in owners(self.get("memories")).collect())

    def note(self, what: str, detail: object) -> None:
        self.log.append((what, str(detail)))


def new_lines(lines: DataFrame, state: DataFrame, first_cap: int | None = None) -> DataFrame:
    """Lines after those that earlier runs processed. Lines with ``start``, their byte in the file, and
    ``size``, the file's, go by bytes, others by numbers (``processed_bytes`` counts lines then). A file that
    shrank is read from the start, a new one's last ``first_cap`` at most; no line at a border is left out."""
    place = "start" if "start" in lines.columns else "line_no"
    size = F.max("size") if "size" in lines.columns else F.max(place) + 1
    known = state.select(F.col("session_file").alias("path"), "processed_bytes")
    ends = lines.groupBy("path").agg(size.alias("_size")).join(known, "path", "left")
    starts = ends.select("path", resume_at(F.col("_size"), F.col("processed_bytes"), first_cap).alias("_from"))
    return lines.join(starts, "path").where(F.col(place) >= F.col("_from")).drop("_from")


def segments_of(transcript: DataFrame, most: int = SEGMENT_CHARS, least: int = LEAST_SEGMENT) -> DataFrame:
    """``path, segment, text, through, skipped`` of formatted lines."""
    record = transcript.groupBy("path", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    sized = record.withColumn("size", F.length("text"))
    cut = greedy_segments(sized, "path", "line_no", "size", most)
    return segment_texts(record, cut, "path", "line_no", "text", least)


def read_sessions(night: Night, lines: DataFrame, first_cap: int | None = None) -> DataFrame:
    """New lines as segments worth a look; the state and the registry move on. Files that no parser
    takes are reported and stay unread."""
    state = night.get("distill_state")
    fresh = durable(new_lines(lines, state, first_cap))
    transcript, errors = parse(fresh)
    errors = durable(errors)
    for r in errors.orderBy("path").limit(100).collect():  # the log names a hundred of them
        night.note("error", f"{r.path}: {r.error}")
    night.note("errors", errors.count())
    segments = durable(segments_of(transcript))
    read = fresh.join(errors, "path", "left_anti")
    end = F.max("size") if "size" in lines.columns else F.max("line_no") + 1
    moved = read.groupBy(F.col("path").alias("session_file")).agg(end.cast("long").alias("processed_bytes")).withColumns({"gist": F.lit(""), "processed_at": night.at})
    night.put("distill_state", state.join(moved, "session_file", "left_anti").unionByName(moved.select(*state.columns)))
    night.put("session_registry", registered(night.get("session_registry"), read, night.at))
    return segments.where("NOT skipped").select("path", "segment", "text")


def read_inbox(night: Night, drops: DataFrame, kept_folder: str | None = None, lenses: DataFrame | None = None) -> DataFrame:
    """Dropped files move on by a state each; windows that the filter keeps come back as segments. A file is
    read by its lenses (``path, lens``), or by the default one. Without money left today no window is asked
    about."""
    files = night.get("inbox_files")
    seen = durable(inbox.registered(files, inbox.slimmed(drops), night.at, lenses))
    broke = night.daily_budget is not None and spent_today(night) >= night.daily_budget
    open_ = seen.where(F.col("status").isin("slimmed", "filtering") & F.lit(not broke))
    known = lenses if lenses is not None else night.store.spark.createDataFrame([], "path string, lens string")
    by = open_.select("path", "lens_offsets").join(known.select("path", "lens").distinct(), "path", "left").withColumn("lens", F.coalesce("lens", F.lit(LENS)))
    by = by.select("path", "lens", F.coalesce(F.col("lens_offsets")[F.col("lens")], F.lit(0)).alias("_done"))
    windows = fixed_windows(open_, "path", "text").join(by, "path").where(F.col("offset") >= F.col("_done"))
    windows = durable(within_budget(windows.withColumn("chars", F.length("window")), "lens", ["path", "offset"], "chars", INBOX_CHARS))
    kept = inbox.kept_windows(windows, durable(night.judge.decide("inbox-filter", windows)), ["path", "offset"])
    kept = durable(kept.select("path", F.col("offset").alias("segment"), F.col("window").alias("text")).distinct())
    night.put("inbox_files", inbox.advanced(seen, windows.groupBy("path", "lens").agg(F.max("offset").alias("through")), night.at))
    if kept_folder:
        sinks.append_kept(kept, kept_folder)
    night.note("inbox windows kept", kept.count())
    return kept


def spent_today(night: Night) -> float:
    today = spend(night.get("token_log"), FILTER_STEPS, *night.prices).where(F.col("day") == F.date_format(night.as_of, "yyyy-MM-dd"))
    return today.agg(F.coalesce(F.sum("spent"), F.lit(0.0))).first()[0]


def learn(night: Night, segments: DataFrame) -> DataFrame:
    """What segments tell, merged into the store; returns the log of rows made."""
    memories = night.get("memories")
    worth = night.judge.decide("triage", segments).where("worth").select("path", "segment")
    reading = segments.join(worth, ["path", "segment"], "left_semi")
    found = durable(night.judge.decide("extract", reading).withColumn("owner", F.lit(night.owner)))
    found = durable(verified(found, night.judge.decide("verify", found)))
    decisions = durable(valid_decisions(night.judge.decide("merge", found), found, memories))
    actions = durable(sequenced(decisions, found.withColumn("source", F.col("path")), None))
    if night.on_actions is not None:
        night.on_actions(actions)
    merged, log = apply_actions(memories, actions, night.get("tombstones"), night.at)
    log = durable(log)
    night.put("memories", merged)
    for r in sinks.nightly_report(log).collect():
        night.note(r.action, f"{r.n} rows, such as {r.ids}")
    night.note("actions", log.count())
    return log


def put_away(night: Night, stones: DataFrame) -> None:
    old = night.get("tombstones")
    night.put("tombstones", old.unionByName(stones.select(*old.columns)).dropDuplicates(["owner", "digest"]))


def fade(night: Night) -> None:
    """Archive old inferences of little confidence."""
    old = durable(upkeep.decayed(night.memories(), night.as_of).select("id"))
    after, stones = upkeep.archive(night.get("memories"), old, "decay", night.at)
    put_away(night, stones)
    night.put("memories", after)
    night.note("archived", old.count())


def reorganise(night: Night, owner: str) -> None:
    """A curation plan for an owner's store, in its four phases."""
    memories = durable(night.memories())
    listed = owned(memories, owner).withColumn("content", F.substring("content", 1, LISTED_CHARS))
    plan = durable(night.judge.decide("reorganize", listed))
    of = lambda op, *columns: plan.where(F.col("op") == op).select(*columns)
    changes, made, stones = upkeep.reorganise(
        memories, of("merge", F.col("place").alias("group_id"), "summary", "content", "keywords", "ids"), of("conflict", "keep_id", "drop_id"),
        of("archive", "id"), of("retag", "id", "kind", "domain"), night.get("tombstones"), owner, night.at,
    )
    changes, made = durable(changes), durable(made)
    put_away(night, stones)
    night.put("memories", upkeep.reorganised(night.get("memories"), changes, made, night.at))
    night.note("reorganised", f"{owner}: {changes.count()} rows, {made.count()} made; {upkeep.flexible(night.memories(), owner).count()} flexible of {upkeep.TARGET_SIZE}")


def synthesis_due(night: Night, owner: str) -> bool:
    """Whether an owner's newest chapter is older than a week, or there is none."""
    newest = latest_by_owner(night.get("profiles").where((F.col("owner") == owner) & (F.col("status") == "active")))
    return newest.where(F.to_date("updated_at") >= F.date_sub(night.as_of, WEEK)).count() == 0


def synthesise(night: Night, owner: str) -> None:
    """Chapters from the store: a tree, texts, what they absorb, and which old ones they replace."""
    memories, profiles, judge = durable(night.memories()), night.get("profiles"), night.judge
    tree = durable(judge.decide("synthesize-cluster", material(memories, owner)))
    demanded = wanted(night.get("slot_demands"), owner)
    night.note("wanted", [r.domain for r in demanded.collect()])
    grown = durable(upkeep.grown_chapters(upkeep.chapters(tree, memories, owner), profiles, memories, owner))
    members = grown.select("theme", F.explode("member_ids").alias("id")).join(memories.select("id", "content"), "id")
    # the beginnings of up to two thousand members, in a size that a prompt takes
    first = F.transform(F.array_sort(F.collect_list(F.struct("id", F.substring("content", 1, LISTED_CHARS).alias("c")))), lambda x: x["c"])
    texts = members.groupBy("theme").agg(F.substring(F.array_join(first, "\n"), 1, SEGMENT_CHARS).alias("text"))
    written = durable(judge.decide("synthesize-theme", texts)).groupBy("theme").agg(F.max("abstract").alias("abstract"), F.max("content").alias("content"))
    rows = grown.join(written, "theme").withColumnRenamed("member_ids", "memory_ids").withColumn("owner", F.lit(owner))
    none = F.lit(None).cast("long")
    roots = upkeep.upsert_profiles(profiles, rows.where("is_domain").withColumn("parent_id", none), night.at)
    roots = durable(upkeep.with_ids(roots, night.at))
    parents = roots.where(F.col("owner") == owner).select(F.col("theme").alias("domain"), F.col("id").alias("parent_id"))
    subs = upkeep.upsert_profiles(roots, rows.where("NOT is_domain").join(parents, "domain"), night.at)
    after = durable(upkeep.with_ids(subs, night.at))
    mine = after.where((F.col("owner") == owner) & (F.col("status") == "active"))
    taken = durable(upkeep.absorb(memories, mine, night.as_of))
    covered = grown.where("NOT is_domain").select(F.explode("member_ids").alias("id"))
    gone = durable(upkeep.retired(mine, memories, covered, grown.select("theme", "title")).select("id"))
    retired = after.join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status")))
    night.put("profiles", retired)
    night.put("memories", upkeep.absorbed(night.get("memories"), taken, night.at))
    night.note("synthesised", f"{owner}: {grown.count()} chapters, {taken.count()} absorbed, {gone.count()} retired")


def retell(night: Night) -> None:
    """Gists of live topics' answered turns, and summaries of topics that went on."""
    replies, topics = night.get("replies"), night.get("topics")
    live = topics.withColumn("last_seen", F.to_date("last_seen_at"))
    asked = conversations.gists_to_regenerate(replies, live, F.date_sub(night.as_of, LIVE_DAYS))
    gists = durable(night.judge.decide("reply-gist", replies.join(asked, ["topic_id", "reply_id"])))
    night.put("replies", conversations.set_gists(replies, gists))
    stale = durable(conversations.stale_topics(replies, topics))
    turns = conversations.last_turns(replies.join(stale, "topic_id", "left_semi"), conversations.SUMMARY_TURNS)
    texts = turns.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reply_id", "query"))), lambda x: x["query"]), "\n").alias("text"))
    night.put("topics", conversations.set_summaries(topics, durable(night.judge.decide("topic-summary", texts)), replies))
    night.note("gists", gists.count())


def refresh_cards(night: Night, owner: str) -> None:
    """Cards of domains whose rows changed, and the owner's card put together from all of them."""
    memories, kv = night.memories(), night.get("kv")
    hashes = durable(upkeep.domain_hashes(memories, F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), owner))
    key = lambda *parts: F.concat(F.lit(f"{CARD}{owner}:"), *parts)
    old = kv.where(F.col("key").startswith(f"{CARD}{owner}:")).select(F.expr(f"substring(key, {len(CARD) + len(owner) + 2})").alias("domain"), F.from_json("value", "hash string, card string").alias("v"))
    old = old.select("domain", "v.hash", "v.card")
    stale = durable(upkeep.stale_cards(hashes, old))
    name = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("general"))
    sample = owned(memories, owner).groupBy(name.alias("domain")).agg(F.max_by("summary", F.struct("evidence", "id")).alias("sample"))
    made = durable(night.judge.decide("store-card", stale.join(sample, "domain").withColumn("owner", F.lit(owner)))).select("domain", F.col("card").alias("_card"))
    cards = durable(hashes.join(old.select("domain", F.col("card").alias("_old")), "domain", "left").join(made, "domain", "left").withColumn("card", F.coalesce("_card", "_old")).where("card IS NOT NULL"))
    rows = cards.select(key("domain").alias("key"), F.to_json(F.struct("hash", "card")).alias("value"))
    whole = sinks.store_card(cards.withColumn("owner", F.lit(owner))).select(F.lit(f"{CARD.rstrip(':')} {owner}").alias("key"), F.col("card").alias("value"))
    new = rows.unionByName(whole)
    mine = F.col("key").startswith(f"{CARD}{owner}:") | (F.col("key") == f"{CARD.rstrip(':')} {owner}")
    night.put("kv", kv.where(~mine).unionByName(new))
    night.note("cards", f"{owner}: {stale.count()} domains")


def run(store: SnapshotStore, lines: DataFrame, judge: Judge, at: Column, as_of: Column, owner: str = "default", drops: DataFrame | None = None, kept_folder: str | None = None, first_cap: int | None = None, daily_budget: float | None = None, prices: tuple[float, float] = (0.0, 0.0), lenses: DataFrame | None = None, on_actions: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """One night. ``lines``: ``path, line_no, value, agent`` (and ``start, size``); ``drops``: entries of dropped
    files, with ``lenses``; ``on_actions`` is shown the actions before they are carried out. All changes become one new version; ``versions`` of the store are its backups."""
    with store.locked():
        base = store.newest()
        night = Night(store, judge, at, as_of, owner, daily_budget, prices, on_actions)
        segments = read_sessions(night, lines, first_cap)
        if drops is not None:
            segments = segments.unionByName(read_inbox(night, drops, kept_folder, lenses))
        log = learn(night, durable(segments))
        fade(night)
        for name in night.owners():
            reorganise(night, name)
            if synthesis_due(night, name):
                synthesise(night, name)
        retell(night)
        for name in night.owners():
            refresh_cards(night, name)
        told = dict(night.log)
        spark, logged = log.sparkSession, night.get("memory_log")
        rows = spark.createDataFrame(night.log, "action string, detail string").withColumn("at", at)
        night.put("memory_log", logged.unionByName(conform(rows, "memory_log")))
        version = store.commit(night.tables, index.entries(night.get("memories").where(F.col("updated_at") >= at)), base)
    return {"version": version, "actions": int(told["actions"]), "errors": int(told["errors"]), "archived": int(told["archived"])}
