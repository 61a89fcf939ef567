"""Relevance queries: text matches, recency and pinned memories, fused into one ranking."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from anamnesis.deploy import durable
from anamnesis.functions.text import query_terms, terms_of
from anamnesis.operators.ranking import union_first
from anamnesis.operators.selection import in_scope, owned
from anamnesis.plans.index import Index, index_of
from anamnesis.plans.scan import MOST_WANTED, best_rows, counts_of, scanned
from anamnesis.schema import STATUSES

MATCHES, SHORT_MATCHES, RECENT, SAME_DOMAIN = 60, 20, 20, 30
#: BM25 as full-text indexes have it.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("summary", "keywords", "content")
HIT, SHORT_HIT, NO_HIT = 1.0, 0.5, 0.2


def _lowered(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_{f}": F.lower(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS})


def _occurrences(term: str) -> Column:
    """How often a term occurs in all fields, overlaps included. Only terms that begin as they end can overlap
    themselves; the others are counted by what is left without them."""
    t = term.lower()
    if any(t[:i] == t[-i:] for i in range(1, len(t))):
        literal = "(?=" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in t) + ")"
        times = lambda field: F.regexp_count(field, F.lit(literal))
    else:
        times = lambda field: ((F.length(field) - F.length(F.replace(field, F.lit(t)))) / len(t)).cast("int")
    return reduce(Column.__add__, (F.when(F.col(f"_{f}").contains(t), times(F.col(f"_{f}"))).otherwise(0) for f in FIELDS))


def _has(term: str) -> Column:
    return reduce(Column.__or__, (F.col(f"_{f}").contains(term.lower()) for f in FIELDS))


def light(memories: DataFrame) -> list[str]:
    """All columns but the long one, which only the final rows need."""
    return [c for c in memories.columns if c != "content"]


def text_hits(memories: DataFrame, terms: list[str], owner: str, statuses: tuple[str, ...]) -> tuple[DataFrame, dict]:
    """The one scan of contents: rows of the owner that hold a term, with how often (``_tf``, by long
    term), which short terms (``_short``) and their size; and the store's counts, observed in the same
    scan. Hits are checkpointed without contents."""
    long_terms, short_terms = [t for t in terms if len(t) >= 3], [t for t in terms if len(t) == 2]
    columns = light(memories)
    if not long_terms and not short_terms:
        none = F.array().cast("array<int>")
        return memories.where("false").select(*columns, F.lit(0).alias("_size"), none.cast("array<double>").alias("_tf"), none.alias("_short")), {}
    size = reduce(Column.__add__, (F.greatest(F.length(f"_{f}") - 2, F.lit(0)) for f in FIELDS))
    seen = Observation()
    counted = [F.count_if(_has(t)).alias(f"t{i}") for i, t in enumerate(long_terms)]
    rows = _lowered(memories).observe(seen, F.count("*").alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean"), *counted)
    tf = F.array(*(_occurrences(t).cast("double") for t in long_terms)).cast("array<double>")
    short = F.array(*(F.when(_has(t), F.lit(i)) for i, t in enumerate(short_terms))).cast("array<int>")
    hit = reduce(Column.__or__, (_has(t) for t in [*long_terms, *short_terms]))
    found = owned(rows, owner, statuses).where(hit).select(
        *columns, size.alias("_size"), tf.alias("_tf"), F.filter(short, lambda x: x.isNotNull()).alias("_short")
    )
    return durable(found), seen.get


def _ranked(hits: DataFrame, stats: dict, columns: list[str], limit: int) -> DataFrame:
    count = sum(k.startswith("t") for k in stats)
    score = F.lit(0.0)
    norm = K1 * (F.lit(1 - B) + B * F.col("_size") / F.lit(max(float(stats.get("mean", 0)), 1.0)))
    for i in range(count):
        n, df = stats["n"], stats[f"t{i}"]
        idf = F.greatest(F.log((F.lit(float(n - df)) + 0.5) / F.lit(df + 0.5)), F.lit(LEAST_IDF))
        tf = F.get("_tf", F.lit(i))
        score += idf * tf * (K1 + 1) / (tf + norm)
    rows = hits.where(F.exists("_tf", lambda x: x > 0)).withColumn("bm25", score)
    return rows.orderBy(F.desc("bm25"), "id").limit(limit).select(*columns, "bm25")


def _short_rows(hits: DataFrame, columns: list[str], each: int) -> DataFrame:
    newest = Window.partitionBy("_term").orderBy(F.desc("last_seen"), F.desc("id"))
    rows = hits.withColumn("_term", F.explode("_short")).withColumn("_rank", F.row_number().over(newest))
    return rows.where(F.col("_rank") <= each).dropDuplicates(["id"]).select(*columns)


def bm25_matches(memories: DataFrame, terms: list[str], owner: str, statuses: tuple[str, ...], limit: int = MATCHES) -> DataFrame:
    """The best matches of terms of three characters or more, with ``bm25`` and without contents."""
    return _ranked(*text_hits(memories, terms, owner, statuses), light(memories), limit)


def short_matches(memories: DataFrame, terms: list[str], owner: str, statuses: tuple[str, ...], each: int = SHORT_MATCHES) -> DataFrame:
    """For terms of two characters: of each the newest rows that contain it."""
    return _short_rows(text_hits(memories, terms, owner, statuses)[0], light(memories), each)


def indexed_hits(memories: DataFrame, terms: list[str], owner: str, statuses: tuple[str, ...], index: Index) -> tuple[DataFrame, dict]:
    """What ``text_hits`` gives, from an index, without reading contents."""
    spark, columns = memories.sparkSession, light(memories)
    long_terms, short_terms = [t for t in terms if len(t) >= 3], [t for t in terms if len(t) == 2]
    if not long_terms and not short_terms:
        return text_hits(memories, terms, owner, statuses)
    names = spark.createDataFrame([(t,) for t in terms], "term string").select(F.lower("term").alias("term")).distinct()
    found = durable(index.hits(names))
    df = {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # twelve rows at most
    by_row = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("_of"), F.first("size").alias("_size"))
    of = lambda t: F.coalesce(F.col("_of")[t.lower()], F.lit(0))
    tf = F.array(*(of(t).cast("double") for t in long_terms)).cast("array<double>")
    short = F.array(*(F.when(of(t) > 0, F.lit(i)) for i, t in enumerate(short_terms))).cast("array<int>")
    rows = owned(memories, owner, statuses).select(*columns).join(by_row, "id")
    hits = durable(rows.select(*columns, "_size", tf.alias("_tf"), F.filter(short, lambda x: x.isNotNull()).alias("_short")))
    return hits, {"n": index.rows, "mean": index.mean} | {f"t{i}": df.get(t.lower(), 0) for i, t in enumerate(long_terms)}


def matches(memories: DataFrame, query: str, owner: str, statuses: tuple[str, ...], limit: int = MATCHES, index: Index | None = None) -> DataFrame:
    """Text matches with ``hit_score``; a row that both ways find counts as a full hit. With an index no
    contents are read."""
    columns, terms = light(memories), terms_of(query)
    hits, stats = text_hits(memories, terms, owner, statuses) if index is None else indexed_hits(memories, terms, owner, statuses, index)
    full = _ranked(hits, stats, columns, limit).drop("bm25").withColumn("hit_score", F.lit(HIT))
    short = _short_rows(hits, columns, SHORT_MATCHES).withColumn("hit_score", F.lit(SHORT_HIT))
    both = union_first([full, short], "id").drop("channel")
    return both.orderBy(F.desc("hit_score"), F.desc("last_seen"), "id").limit(limit)


def candidates(memories: DataFrame, query: str, owner: str, statuses: tuple[str, ...], domains: tuple[str, ...] = (), index: Index | None = None) -> DataFrame:
    """Matches, the most recent and the pinned memories, and the best supported of ``domains``, without
    contents; ``channel`` says which found a row first."""
    own = owned(memories, owner, statuses).select(*light(memories))
    recent = own.orderBy(F.desc("last_seen"), "id").limit(RECENT).withColumn("hit_score", F.lit(NO_HIT))
    pinned = own.where("pinned = 1").withColumn("hit_score", F.lit(NO_HIT))
    channels = [matches(memories, query, owner, statuses, index=index), recent, pinned]
    if domains:
        same = own.where(F.col("domain").isin(*domains)).orderBy(F.desc("evidence"), F.desc("last_seen"), "id").limit(SAME_DOMAIN)
        channels.append(same.withColumn("hit_score", F.lit(NO_HIT)))
    return union_first(channels, "id")


def fused_score(as_of: Column) -> Column:
    """Relevance dominates; a half-life of thirty days, evidence and pins add to it."""
    age = F.greatest(F.datediff(as_of, F.col("last_seen")), F.lit(0)).cast("double")
    boost = 1 + 0.3 * F.pow(F.lit(0.5), age / 30) + 0.1 * F.log1p(F.col("evidence").cast("double"))
    return F.col("hit_score") * (boost + 0.5 * F.col("pinned"))


def fast_recall(
    memories: DataFrame,
    query: str,
    as_of: Column,
    k: int = 5,
    owner: str = "default",
    scope: str = "all",
    cwd: str | None = None,
    excavate: bool = False,
    ledger: DataFrame | None = None,
    index: Index | None = None,
) -> DataFrame:
    """The ``k`` best candidates. The scope applies after the channels' caps, and ``ledger`` (``item`` as
    ``m:<id>``) removes what a conversation has had, so fewer than ``k`` rows may remain."""
    rows = candidates(memories, query, owner, STATUSES if excavate else ("active",), index=index).where(in_scope(scope, cwd))
    rows = rows.withColumn("score", fused_score(as_of))
    if ledger is not None:
        rows = rows.withColumn("item", F.concat(F.lit("m:"), F.col("id").cast("string")))
        rows = rows.join(ledger.select("item"), "item", "left_anti").drop("item")
    best = rows.orderBy(F.desc("score"), "channel", "id").limit(min(k, 20)).select("id", "channel", "score")
    # at most twenty rows: a broadcast of proven size fetches their contents; the limit spares the sort a sample
    return memories.join(F.broadcast(best), "id").orderBy(F.desc("score"), "channel", "id").limit(min(k, 20))


def _best(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def recall_many(
    memories: DataFrame,
    questions: DataFrame,
    as_of: Column,
    k: int = 5,
    owner: str = "default",
    scope: str = "all",
    cwd: str | None = None,
    excavate: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """``question, id, channel, score``: for each of many questions (``question, text``) what ``fast_recall``
    gives. All terms of all questions are joined with the index; without one, contents are read once, whole rows are scored where
    they lie, and only the best of each task move (with more than ``MOST_WANTED`` terms postings are made for the occasion). Questions
    are a table like others: beyond those terms nothing but the store's counts and its most recent and pinned rows reaches the driver."""
    statuses, k = STATUSES if excavate else ("active",), min(k, 20)
    asked = questions.select(F.col("question").cast("long").alias("question"), query_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    # a term counts as often as the question has it
    wanted = asked.select("question", F.explode("terms").alias("term")).groupBy("question", F.lower("term").alias("term")).agg(F.count("*").alias("times"))
    wanted = durable(wanted)
    own = owned(memories, owner, statuses).select(*light(memories))
    few = wanted.limit(MOST_WANTED + 1).collect() if index is None else []
    if index is None and len(few) <= MOST_WANTED:
        full, short = _scanned(memories, few, (F.col("owner") == owner) & F.col("status").isin(*statuses))
    else:
        full, short = _joined(index or index_of(memories), wanted, own)
    hits = full.unionByName(short).groupBy("question", "id").agg(F.max("hit_score").alias("hit_score"))
    ranked = durable(_best(own.join(hits, "id"), ["question"], [F.desc("hit_score"), F.desc("last_seen"), F.col("id")], MATCHES)).withColumn("channel", F.lit(0))
    # recent and pinned rows score alike for all questions; of these no more than the answer and all hits can matter
    recent = own.orderBy(F.desc("last_seen"), "id").limit(RECENT)
    rest = union_first([recent, own.where("pinned = 1")], "id").withColumn("channel", F.col("channel") + 1)
    rest = rest.withColumn("hit_score", F.lit(NO_HIT)).where(in_scope(scope, cwd)).withColumn("score", fused_score(as_of))
    rest = rest.orderBy(F.desc("score"), "channel", "id").limit(k + MATCHES).select("id", "channel", "score")
    filled = _with_each(asked.select("question"), rest)
    scored = ranked.where(in_scope(scope, cwd)).select("question", "id", "channel", fused_score(as_of).alias("score"))
    # a row that was hit, in scope or not, doesn't come by another way
    filled = filled.join(ranked.select("question", "id"), ["question", "id"], "left_anti")
    return _best(scored.unionByName(filled), ["question"], [F.desc("score"), F.col("channel"), F.col("id")], k)


def _joined(index: Index, wanted: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``question, id, hit_score`` of the best matches and of those of terms of two characters, from an index."""
    found = durable(index.hits(wanted.select("term").distinct()))
    chars = F.length("term")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(float(index.rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    norm = K1 * (F.lit(1 - B) + B * F.col("size") / F.lit(max(float(index.mean), 1.0)))
    mine = found.join(own.select("id", "last_seen"), "id").join(df, "term").join(wanted, "term")
    score = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    full = mine.where(chars >= 3).groupBy("question", "id").agg(F.sum(score).alias("bm25"))
    full = _best(full, ["question"], [F.desc("bm25"), F.col("id")], MATCHES).select("question", "id", F.lit(HIT).alias("hit_score"))
    short = _best(mine.where(chars == 2), ["question", "term"], [F.desc("last_seen"), F.desc("id")], SHORT_MATCHES)
    return full, short.select("question", "id", F.lit(SHORT_HIT).alias("hit_score"))


def _scanned(memories: DataFrame, wanted: list, own: Column) -> tuple[DataFrame, DataFrame]:
    """As ``_joined``, from contents."""
    terms = sorted({r.term for r in wanted})
    number = {t: i for i, t in enumerate(terms)}
    held = scanned(memories, terms, own)
    rows, mean, df = counts_of(held)
    weights = [max(math.log((rows - n + 0.5) / (n + 0.5)), LEAST_IDF) for n in (df.get(i, 0) for i in range(len(terms)))]
    short = [len(t) == 2 for t in terms]
    asked = sorted((number[r.term], r.question, r.times) for r in wanted)
    long_ = [a for a in asked if not short[a[0]]]
    best = durable(best_rows(held, long_, weights, short, max(float(mean), 1.0), K1, B, MATCHES, SHORT_MATCHES))
    full = _best(best.where("NOT short"), ["key"], [F.desc("score"), F.col("id")], MATCHES)
    newest = _best(best.where("short"), ["key"], [F.desc("seen"), F.desc("id")], SHORT_MATCHES)
    of = memories.sparkSession.createDataFrame([a[:2] for a in asked if short[a[0]]], "key long, question long")
    return full.select(F.col("key").alias("question"), "id", F.lit(HIT).alias("hit_score")), newest.join(of, "key").select("question", "id", F.lit(SHORT_HIT).alias("hit_score"))


def _with_each(questions: DataFrame, rest: DataFrame) -> DataFrame:
    """Each question with the same few rows (``id, channel, score``, at most some eighty)."""
    fill = rest.collect()
    if not fill:
        return questions.where("false").withColumns({"id": F.lit(0).cast("long"), "channel": F.lit(0), "score": F.lit(0.0)})
    every = F.array(*(F.struct(F.lit(r.id).cast("long").alias("id"), F.lit(r.channel).alias("channel"), F.lit(r.score).cast("double").alias("score")) for r in fill))
    return questions.select("question", F.inline(every))
