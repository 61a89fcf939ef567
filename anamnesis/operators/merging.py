"""The store's state machine: insert, reinforce, refine, supersede, archive.

In a batch an earlier action can change what a later one may do: support raises a target's
confidence, which can close it to successors. How much support that takes is known from the
start, so one running count by target, in the order of ``seq``, judges each action, and sums do
the rest; no row gathers a target's actions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.deploy import durable
from anamnesis.functions.text import digest, strip
from anamnesis.operators.ranking import numbered
from anamnesis.schema import KINDS

PROTECTED = 0.8
STEP = 0.05
#: After so much support any confidence is 1.
MOST_SUPPORT = 21


def may_supersede(old_origin: Column, old_confidence: Column, origin: Column, confidence: Column) -> Column:
    """A confident statement of the user gives way only to another one."""
    kept = (old_origin == "user_stated") & (old_confidence >= PROTECTED)
    return ~kept | ((origin == "user_stated") & (confidence >= PROTECTED))


def reinforced(confidence: Column) -> Column:
    return F.least(F.lit(1.0), confidence + STEP)


def valid_kind(kind: Column) -> Column:
    return F.when(kind.isin(*KINDS), kind).otherwise("lesson")


def tombstones_of(memories: DataFrame, reason: str, at: Column) -> DataFrame:
    """Marks against contents that were put away; blank ones leave none."""
    rows = memories.where(F.length(strip(F.col("content"))) > 0)
    return rows.select(
        digest(F.col("content")).alias("digest"), "owner", F.lit(reason).alias("reason"), F.col("id").alias("source_id"), at.alias("created_at")
    ).dropDuplicates(["owner", "digest"])


def without_tombstoned(rows: DataFrame, tombstones: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose owner hasn't put an equal content away."""
    marked = rows.withColumn("digest", digest(F.col(content)))
    return marked.join(tombstones.select("owner", "digest"), ["owner", "digest"], "left_anti").drop("digest")


def flag_tombstoned(rows: DataFrame, tombstones: DataFrame, content: str) -> DataFrame:
    """``rows`` with ``tombstoned``."""
    marks = tombstones.select("owner", "digest").distinct().withColumn("_mark", F.lit(True))
    marked = rows.withColumn("digest", digest(F.coalesce(F.col(content), F.lit(""))))
    blank = F.length(strip(F.coalesce(F.col(content), F.lit("")))) == 0
    return (
        marked.join(marks, ["owner", "digest"], "left")
        .withColumn("tombstoned", F.coalesce(F.col("_mark") & ~blank, F.lit(False)))
        .drop("_mark", "digest")
    )


def supported(confidence: Column, times: Column) -> Column:
    """A confidence after so many times of support, added one by one."""
    steps = F.sequence(F.lit(1), F.least(times.cast("int"), F.lit(MOST_SUPPORT)))
    return F.when(times > 0, F.aggregate(steps, confidence, lambda c, _: reinforced(c))).otherwise(confidence)


def _support_to_close(origin: Column, confidence: Column) -> Column:
    """How much support closes a row to all but confident statements of the user; null if none does."""
    start = F.struct(confidence.alias("c"), F.lit(0).alias("n"))
    step = lambda s, _: F.when(s["c"] >= PROTECTED, s).otherwise(F.struct(reinforced(s["c"]).alias("c"), (s["n"] + 1).alias("n")))
    return F.when(origin == "user_stated", F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SUPPORT)), start, step, lambda s: s["n"]))


def judged(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """``actions`` with ``done`` (a supersession that is carried out), ``support`` and ``refused``. Those with a
    target but none in ``memories`` of the same owner fall away."""
    closes = _support_to_close(F.col("origin"), F.col("confidence")).alias("_closes")
    targets = memories.select(F.col("id").alias("target_id"), "owner", closes)
    rows = actions.where("target_id IS NOT NULL").join(targets, ["target_id", "owner"])
    before = Window.partitionBy("target_id", "owner").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    given = F.coalesce(F.sum((F.col("action") == "REINFORCE").cast("int")).over(before), F.lit(0))
    strong = F.coalesce((F.col("origin") == "user_stated") & (F.col("confidence") >= PROTECTED), F.lit(False))
    closed = F.coalesce(given >= F.col("_closes"), F.lit(False)) & ~strong
    succeed = F.col("action") == "SUPERSEDE"
    marks = {"done": succeed & ~closed & ~F.col("tombstoned"), "refused": succeed & closed}
    told = rows.withColumns(marks).withColumn("support", (F.col("action") == "REINFORCE") | F.col("refused"))
    free = actions.where("target_id IS NULL").withColumns({c: F.lit(False) for c in ("done", "refused", "support")})
    names = [*actions.columns, "done", "refused", "support"]
    return told.select(*names).unionByName(free.select(*names))


def _sums(told: DataFrame) -> DataFrame:
    """What the judged actions come to, by target."""
    refine = F.col("action") == "REFINE"
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    words = F.col("keywords").isNotNull() & (F.size("keywords") > 0)
    return told.where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("id"), "owner").agg(
        F.count_if("support").alias("_support"), F.count_if(refine).alias("_refined"), F.max("done").alias("_done"),
        F.count_if((F.col("action") == "SUPERSEDE") & ~F.col("done")).alias("blocked"), last(F.col("content"), refine).alias("_content"),
        last(F.col("summary"), refine & (F.length("summary") > 0)).alias("_summary"), last(F.array_join("keywords", " "), refine & words).alias("_keywords"),
    )


def _moved(rows: DataFrame) -> DataFrame:
    """Rows of the store, joined with their sums if they have some, as they are after the batch."""
    support, refined = (F.coalesce(c, F.lit(0)) for c in ("_support", "_refined"))
    return rows.withColumns(
        {c: F.coalesce(f"_{c}", c) for c in ("content", "summary", "keywords")}
        | {
            "evidence": (F.col("evidence") + support + refined).cast("long"),
            "confidence": supported(F.col("confidence"), support),
            "status": F.when(F.col("_done"), "superseded").otherwise(F.col("status")),
        }
    )


def fold_actions(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """The targets of ``actions`` after them, with ``blocked``, how many supersessions weren't carried out."""
    return _moved(memories.join(_sums(judged(memories, actions)), ["id", "owner"])).select(*memories.columns, "blocked")


def insertions(actions: DataFrame, born: DataFrame, first_id: int) -> DataFrame:
    """Rows that NEW actions and carried-out SUPERSEDE actions (``born``: ``seq, replaces``) create, with ids in the
    order of ``seq``."""
    fresh = actions.where("action = 'NEW' AND NOT tombstoned").select("seq", F.lit(None).cast("long").alias("replaces"))
    made = numbered(born.select("seq", "replaces").unionByName(fresh), "seq", name="id")
    return (
        actions.join(made, "seq")
        .withColumn("id", F.col("id") + F.lit(first_id - 1))
        .withColumns({"kind": valid_kind(F.col("kind")), "evidence": F.lit(1).cast("long"), "status": F.lit("active"), "keywords": F.coalesce(F.array_join("keywords", " "), F.lit(""))})
    )


def first_free(memories: DataFrame) -> int:
    return memories.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1


def as_rows(made: DataFrame, memories: DataFrame, at: Column) -> DataFrame:
    """Inserted rows with the columns of the store."""
    stamped = made.withColumns({"created_at": at, "updated_at": at, "last_seen_at": at, "pinned": F.lit(0), "mini": F.lit("")})
    present, types = set(stamped.columns), {f.name: f.dataType for f in memories.schema}
    return stamped.select(*((F.col(c) if c in present else F.lit(None)).cast(types[c]).alias(c) for c in memories.columns))


def inserted(memories: DataFrame, actions: DataFrame, tombstones: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that a batch of NEW actions adds, and the log. Of the store only ids are read."""
    flagged = flag_tombstoned(actions, tombstones, "content")
    none = actions.sparkSession.createDataFrame([], "seq long, replaces long")
    made = insertions(flagged, none, first_free(memories))
    return as_rows(made, memories, at), made.select("seq", "action", F.col("id").alias("new_id"), "replaces")


def apply_actions(memories: DataFrame, actions: DataFrame, tombstones: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The store after a batch of actions, and the log. ``memories`` has the table's columns;
    ``actions`` has ``seq, action, target_id, owner, cwd, kind, domain, summary, content, keywords, origin,
    confidence, source``; each has a ``seq`` of its own, which is its place in the batch."""
    if actions.groupBy("seq").count().where("count > 1").limit(1).count():
        raise ValueError("two actions have the same seq")
    # several results use the judged actions
    told = durable(judged(memories, flag_tombstoned(actions, tombstones, "content")))
    born = told.where("done").select("seq", F.col("target_id").alias("replaces"))
    made = insertions(told.drop("done", "refused", "support"), born, first_free(memories))
    pointer = made.where("replaces IS NOT NULL").groupBy(F.col("replaces").alias("id")).agg(F.max_by("id", "seq").alias("_by"))
    sums = _sums(told).withColumn("_hit", F.lit(True))
    touched = (F.coalesce("_support", F.lit(0)) + F.coalesce("_refined", F.lit(0))) > 0
    rows = memories.join(sums, ["id", "owner"], "left").join(pointer, "id", "left")
    # only support and refinement touch the time of the last sighting
    stamps = {"updated_at": F.when(F.col("_hit"), at).otherwise(F.col("updated_at")), "last_seen_at": F.when(touched, at).otherwise(F.col("last_seen_at"))}
    changed = _moved(rows.withColumns({"superseded_by": F.coalesce("_by", "superseded_by")} | stamps)).select(*memories.columns)
    log = made.select("seq", "action", F.col("id").alias("new_id"), "replaces")
    return changed.unionByName(as_rows(made, memories, at)), log


def sequenced(decisions: DataFrame, found: DataFrame, cwd: str | None) -> DataFrame:
    """Decisions as actions: each gets a ``seq``, in the order of the candidates and, of one candidate, that
    in which they stand (``_row``, see ``valid_decisions``); ``found`` is the candidates."""
    given = found.select("index", "origin", "confidence", "source")
    return (
        numbered(decisions, "index", "_row", name="seq")
        .join(given, "index")
        .withColumn("cwd", F.lit(cwd).cast("string"))
        .select("seq", "action", "target_id", "owner", "cwd", "kind", "domain", "summary", "content", "keywords", "origin", "confidence", "source")
    )


def valid_decisions(decisions: DataFrame, candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """A selector's merge decisions that can be carried out: a known candidate, an active target of
    the same owner, and the texts that the action needs. Up to eight keywords stay. ``_row`` is a decision's
    place among the others."""
    texts = F.length(F.coalesce("content", F.lit(""))) > 0
    named = F.length(F.coalesce("summary", F.lit(""))) > 0
    complete = (
        F.when(F.col("action") == "NEW", F.lit(True))
        .when(F.col("action") == "REINFORCE", F.col("target_id").isNotNull())
        .when(F.col("action") == "REFINE", F.col("target_id").isNotNull() & texts)
        .when(F.col("action") == "SUPERSEDE", F.col("target_id").isNotNull() & texts & named)
        .otherwise(False)
    )
    known = memories.where("status = 'active'").select(F.col("id").alias("target_id"), "owner")
    placed = decisions.withColumn("_row", F.monotonically_increasing_id())
    rows = placed.where(complete).join(candidates.select("index", "owner"), "index")
    targeted = rows.where("target_id IS NOT NULL").join(known, ["target_id", "owner"], "left_semi")
    return rows.where("target_id IS NULL").unionByName(targeted.select(*rows.columns)).withColumn("keywords", F.slice("keywords", 1, 8))


def verified(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates whose verdict is to keep them, with the verdict's confidence and origin."""
    kept = verdicts.where("verdict = 'keep'").select("index", F.col("confidence").alias("_c"), F.col("origin").alias("_o"))
    return candidates.join(kept, "index").withColumns({"confidence": F.coalesce("_c", "confidence"), "origin": F.coalesce("_o", "origin")}).drop("_c", "_o")
