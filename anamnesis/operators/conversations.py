"""Topics and their turns: numbering, recent turns, context packing, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from anamnesis.functions.text import clip, grounded, scrub, squeeze
from anamnesis.operators.ranking import numbered

CONTEXT_CHARS, VERBATIM_TURNS, VERBATIM_CHARS, GIST_CHARS, MARGIN = 32_000, 3, 4000, 300, 20
STALE_TURNS, SUMMARY_TURNS, LEAST_CHARS = 8, 12, 15
QUERY_CHARS, KEPT_GIST, LEAST_LINE = 20_000, 500, 3
# Headings of a context's parts.
SUMMARY_LABEL, VERBATIM_LABEL, GISTS_LABEL = "话题概要：", "最近用户轮原文：\n", "逐轮纪要（新→旧）：\n"


def _newest() -> WindowSpec:
    return Window.partitionBy("topic_id").orderBy(F.desc("reply_id"))


def numbered_turns(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns with ``reply_id``, 1, 2, ... in each conversation, and the query as it is kept."""
    inside = Window.partitionBy(conversation).orderBy(order)
    return turns.select(
        F.col(conversation).alias("topic_id"),
        F.row_number().over(inside).cast("long").alias("reply_id"),
        scrub(F.substring("text", 1, QUERY_CHARS)).alias("query"),
    )


def last_turns(replies: DataFrame, n: int = VERBATIM_TURNS) -> DataFrame:
    """The last ``n`` turns of each topic."""
    return replies.withColumn("_n", F.row_number().over(_newest())).where(F.col("_n") <= n).drop("_n")


def latest_unanswered(replies: DataFrame) -> DataFrame:
    """Of each topic the turn that an answer would go to."""
    return replies.where("answer = ''").groupBy("topic_id").agg(F.max("reply_id").alias("reply_id"))


def attach_answers(replies: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (``topic_id, answer``) put on the latest turn without one; of several the last by ``seq``."""
    last = answers.groupBy("topic_id").agg(scrub(F.substring(F.max_by("answer", "seq"), 1, QUERY_CHARS)).alias("_answer"))
    target = latest_unanswered(replies).join(last, "topic_id")
    return replies.join(target, ["topic_id", "reply_id"], "left").withColumn("answer", F.coalesce("_answer", "answer")).drop("_answer")


def earlier_gists(replies: DataFrame, n: int = 3) -> DataFrame:
    """``topic_id, reply_id, gists``: up to ``n`` gists before each turn, oldest first.

    Gists are numbered in each topic, and a turn is joined to the numbers it wants, so no row
    gathers a whole topic.
    """
    before = Window.partitionBy("topic_id").orderBy("reply_id").rowsBetween(Window.unboundedPreceding, -1)
    has = (F.col("gist") != "").cast("int")
    rows = replies.withColumn("_before", F.coalesce(F.sum(has).over(before), F.lit(0)))
    gists = rows.where("gist != ''").select("topic_id", (F.col("_before") + 1).alias("_k"), F.concat_ws(". ", F.col("reply_id").cast("string"), "gist").alias("_gist"))
    wanted = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_before") - (n - 1)), F.col("_before"))
    asked = rows.where("_before > 0").select("topic_id", "reply_id", F.explode(wanted).alias("_k"))
    found = asked.join(gists, ["topic_id", "_k"]).groupBy("topic_id", "reply_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_gist"))).alias("_found"))
    return replies.join(found, ["topic_id", "reply_id"], "left").select(
        "topic_id", "reply_id", F.coalesce(F.transform("_found", lambda g: g["_gist"]), F.array().cast("array<string>")).alias("gists")
    )


def packed_context(replies: DataFrame, summary: Column, budget: int = CONTEXT_CHARS) -> DataFrame:
    """``topic_id, reply_id, part, chars, line``: what goes into each topic's context.

    The summary and the last three turns come first; then, newest first, one line per earlier turn
    until the first that has no room. ``summary`` is a column of ``replies``. The lines are
    counted once against the budget.
    """
    n = F.row_number().over(_newest())
    # no more lines than this can have room, so of a longer topic only the newest turns are looked at
    replies = replies.withColumn("_n", n).where(F.col("_n") <= budget // LEAST_LINE + VERBATIM_TURNS + 1)
    n = F.col("_n")
    line = F.when(F.col("gist") != "", F.col("gist")).otherwise(F.concat(F.lit("用户："), clip(squeeze(F.col("query")), GIST_CHARS)))
    said = clip(squeeze(F.col("query")), VERBATIM_CHARS)
    number = F.length(F.col("reply_id").cast("string")) + 2
    rows = replies.select(
        "topic_id", "reply_id", n.alias("n"),
        F.when(F.length(summary) > 0, F.length(summary) + len(SUMMARY_LABEL)).otherwise(0).alias("summary_chars"),
        (number + F.length(said)).alias("verbatim"),
        (number + F.length(line)).alias("line"),
        F.concat(F.col("reply_id").cast("string"), F.lit(". "), F.when(n <= VERBATIM_TURNS, said).otherwise(line)).alias("_text"),
    )
    recent = F.col("n") <= VERBATIM_TURNS
    whole = Window.partitionBy("topic_id")
    running = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = F.sum(F.when(recent, 1).otherwise(0)).over(whole) - 1
    fixed = F.sum(F.when(recent, F.col("verbatim")).otherwise(0)).over(whole) + breaks + F.col("summary_chars") + len(VERBATIM_LABEL)
    used = fixed + F.sum(F.when(recent, 0).otherwise(F.col("line"))).over(running)
    rows = rows.withColumn("_over", F.when(recent, False).otherwise(used + MARGIN > budget))
    kept = rows.withColumn("_stop", F.max("_over").over(running)).where(~F.col("_stop"))
    part = F.when(recent, "verbatim").otherwise("gist")
    chars = F.when(recent, F.col("verbatim")).otherwise(F.col("line"))
    return kept.select("topic_id", "reply_id", part.alias("part"), chars.cast("long").alias("chars"), F.col("_text").alias("line"))


def context_text(replies: DataFrame, summary: Column, budget: int = CONTEXT_CHARS) -> DataFrame:
    """``topic_id, context``: the summary, the last turns from old to new, and lines of earlier ones from new
    to old, as far as the budget goes; so what is gathered of a topic is bounded."""
    lines = packed_context(replies, summary, budget)
    place = F.struct(F.when(F.col("part") == "verbatim", F.col("reply_id")).otherwise(-F.col("reply_id")).alias("at"), "line")
    gathered = lambda part: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, place))), lambda x: x["line"])
    texts = lines.groupBy("topic_id").agg(gathered("verbatim").alias("_v"), gathered("gist").alias("_g"))
    known = replies.select("topic_id", summary.alias("_s")).groupBy("topic_id").agg(F.max("_s").alias("_s"))
    part = lambda label, value: F.when(F.length(value) > 0, F.concat(F.lit(label), value))
    shown = F.concat_ws("\n\n", part(SUMMARY_LABEL, F.col("_s")), part(VERBATIM_LABEL, F.array_join("_v", "\n")), part(GISTS_LABEL, F.array_join("_g", "\n")))
    return texts.join(known, "topic_id").select("topic_id", shown.alias("context"))


def set_gists(replies: DataFrame, gists: DataFrame) -> DataFrame:
    """Replies with new gists (``topic_id, reply_id, gist``) of up to 500 characters, where a word of the
    gist stands in the turn; the others keep what they have."""
    new = gists.groupBy("topic_id", "reply_id").agg(F.max("gist").alias("_gist"))
    fits = F.coalesce(grounded(F.col("_gist"), F.concat_ws("\n", "query", "answer")), F.lit(False))
    rows = replies.join(new, ["topic_id", "reply_id"], "left")
    return rows.withColumn("gist", F.when(fits, F.substring("_gist", 1, KEPT_GIST)).otherwise(F.col("gist"))).select(*replies.columns)


def log_turns(replies: DataFrame, topics: DataFrame, added: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Replies and topics after new turns (``conversation, seq, query, injected``): a conversation is a topic,
    and its turns go on where they ended."""
    ids = topics.agg(F.coalesce(F.max("topic_id"), F.lit(0)).alias("_top"))
    names = added.select("conversation").distinct()
    fresh = numbered(names.join(topics, "conversation", "left_anti").withColumn("_hash", F.xxhash64("conversation")), "_hash", "conversation")
    top = ids.first()[0]
    first = added.groupBy("conversation").agg(F.substring(F.min_by("query", "seq"), 1, SUMMARY_TURNS * LEAST_CHARS).alias("first_reply"))
    new = fresh.select("conversation", (F.col("number") + top).alias("topic_id")).join(first, "conversation")
    new = new.withColumns({"summary": F.lit(""), "summary_at": F.lit(0).cast("long"), "first_seen_at": at, "last_seen_at": at})
    seen = topics.join(names.withColumn("_new", F.lit(True)), "conversation", "left")
    kept = seen.withColumn("last_seen_at", F.when(F.col("_new"), at).otherwise(F.col("last_seen_at"))).select(*topics.columns)
    after = kept.unionByName(new.select(*topics.columns))
    last = replies.groupBy("topic_id").agg(F.max("reply_id").alias("_last"))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("seq"))
    rows = added.join(after.select("conversation", "topic_id"), "conversation").join(last, "topic_id", "left")
    turns = rows.select(
        "topic_id", (F.coalesce("_last", F.lit(0)) + place).cast("long").alias("reply_id"), scrub(F.substring("query", 1, QUERY_CHARS)).alias("query"),
        "injected", F.lit("").alias("answer"), F.lit("").alias("gist"), at.alias("created_at"),
    )
    return replies.unionByName(turns.select(*replies.columns)), after


def set_summaries(topics: DataFrame, summaries: DataFrame, replies: DataFrame) -> DataFrame:
    """Topics with new summaries (``topic_id, summary``), as of their last turn."""
    last = replies.groupBy("topic_id").agg(F.max("reply_id").alias("_last"))
    new = summaries.groupBy("topic_id").agg(F.max("summary").alias("_summary")).join(last, "topic_id", "left")
    rows = topics.join(new, "topic_id", "left")
    given = F.length(F.coalesce("_summary", F.lit(""))) > 0
    changed = {"summary": F.when(given, F.col("_summary")).otherwise(F.col("summary")), "summary_at": F.when(given, F.coalesce("_last", F.lit(0))).otherwise(F.col("summary_at"))}
    return rows.withColumns(changed).select(*topics.columns)


def turns_since_summary(replies: DataFrame, topics: DataFrame) -> DataFrame:
    last = replies.groupBy("topic_id").agg(F.max("reply_id").alias("last"))
    gap = F.coalesce("last", F.lit(0)) - F.coalesce("summary_at", F.lit(0))
    return topics.join(last, "topic_id", "left").select("topic_id", gap.cast("long").alias("turns"))


def stale_topics(replies: DataFrame, topics: DataFrame, turns: int = STALE_TURNS) -> DataFrame:
    """Topics whose summary is so many turns old, with the turns to send: the last twelve of those with
    enough text."""
    old = turns_since_summary(replies, topics).where(F.col("turns") >= turns)
    rows = last_turns(replies.join(old, "topic_id", "left_semi"), SUMMARY_TURNS)
    solid = F.length(F.regexp_replace("query", r"[\s\p{Z}]", "")) >= LEAST_CHARS
    sent = rows.where(solid).groupBy("topic_id").agg(F.count("*").alias("sent"))
    return old.join(sent, "topic_id", "left").select("topic_id", "turns", F.coalesce("sent", F.lit(0)).alias("sent"))


def gists_to_regenerate(replies: DataFrame, topics: DataFrame, since: Column, limit: int = 150) -> DataFrame:
    """Answered turns of topics seen since then: newest topics first, turns in order."""
    live = topics.where(F.col("last_seen") > since).select("topic_id")
    rows = replies.where("answer != ''").join(live, "topic_id", "left_semi")
    return rows.orderBy(F.desc("topic_id"), "reply_id").limit(limit).select("topic_id", "reply_id")


LEDGER_HOURS = 48


def log_injections(ledger: DataFrame, added: DataFrame, now: Column, hours: int = LEDGER_HOURS) -> DataFrame:
    """The ledger of ``conversation, item, injected_at`` with new rows: the first of each stays, and rows
    older than 48 hours go."""
    kept = ledger.where(F.col("injected_at") >= now - F.make_dt_interval(hours=F.lit(hours)))
    both = kept.unionByName(added.select("conversation", "item", "injected_at"))
    return both.groupBy("conversation", "item").agg(F.min("injected_at").alias("injected_at"))


def standing_injections(log: DataFrame, now: Column, hours: int = LEDGER_HOURS) -> DataFrame:
    """The ledger (``conversation, item, injected_at``) that follows from a log to which rows are only added: a row without
    an item clears its conversation of all with a smaller ``mark``, and what is older than 48 hours doesn't count."""
    cleared = log.where("item IS NULL").groupBy("conversation").agg(F.max("mark").alias("_cleared"))
    rows = log.where(F.col("item").isNotNull() & (F.col("injected_at") >= now - F.make_dt_interval(hours=F.lit(hours))))
    rows = rows.join(cleared, "conversation", "left").where("mark > coalesce(_cleared, -1)")
    return rows.groupBy("conversation", "item").agg(F.min("injected_at").alias("injected_at"))


def clear_injections(ledger: DataFrame, conversation: str) -> DataFrame:
    return ledger.where(F.col("conversation") != conversation)
