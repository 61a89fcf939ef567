"""A positional index of the store's texts by runs of three characters, kept beside its tables.

``postings`` (``gram, id, places, mark``) has for each row and run the places where it begins, sorted by run and row,
so that a question reads only the files' parts with its own runs, and a common run is spread over many files. A
run is a number, 21 bits for each character, so those that begin with the same two lie together. ``sizes`` (``id,
size, mark``) has what the ranking needs of all rows. A write adds entries of the rows that it touched with a later
mark; of each row only those with its latest mark count.

What a term of three characters or more occurs in, and how often, follows from places alone: of the runs that cover it the
rarest gives the rows that can hold it, and the others' places, moved back by where they stand in the term, must
contain the same starts. So no content is read, and what is joined is bounded by the rarest runs' rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.deploy import durable

FIELDS = ("summary", "keywords", "content")
RUN, BITS = 3, 21
#: Runs that are looked for by value, which the scan can skip by; more are joined.
MOST_RUNS = 2000
#: Characters that are indexed at once.
BLOCK_CHARS = 2_000_000

_ARROW = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("places", pa.list_(pa.int32()))])


def _entries_of(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """Entries of some rows, by array operations over all of them."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    inside = place < sizes[owner] - (RUN - 1)
    padded = np.concatenate([codes, [0, 0]])
    grams = (padded[:-2] << 2 * BITS | padded[1:-1] << BITS | padded[2:])[inside]
    owner, place = owner[inside], place[inside]
    order = np.lexsort((grams, owner))  # stable, so places stay in order
    grams, owner, place = grams[order], owner[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])[: len(grams)])
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)), pa.int32()), pa.array(place, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(grams[first]), pa.array(np.array(ids, np.int64)[owner[first]]), places], schema=_ARROW)


def postings_of(rows: DataFrame) -> DataFrame:
    """``gram, id, places`` of rows of the store, where they lie. Fields are put together with line ends, which no term
    has; two at the end let a run begin at each character."""
    lowered = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS]

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                texts.append(text)
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield _entries_of(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield _entries_of(ids, texts)

    text = F.concat(F.concat_ws("\n", *lowered), F.lit("\n\n"))
    return rows.select("id", text.alias("text")).mapInArrow(run, "gram long, id long, places array<int>")


def size_of() -> Column:
    """A row's number of runs within its fields."""
    lowered = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS]
    return sum((F.greatest(F.length(f) - (RUN - 1), F.lit(0)) for f in lowered[1:]), F.greatest(F.length(lowered[0]) - (RUN - 1), F.lit(0))).cast("long")


def entries(rows: DataFrame) -> dict[str, DataFrame]:
    """What to add to the index for new or changed rows of the store."""
    mark = F.lit(time.time_ns()).alias("mark")
    sizes = rows.select("id", size_of().alias("size"), mark)
    postings = postings_of(rows).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").select("*", mark)
    return {"postings": postings, "sizes": sizes}


def _gram(text: Column) -> Column:
    letter = lambda i: F.ascii(F.substring(text, i, 1)).cast("long")
    return F.shiftleft(letter(1), 2 * BITS).bitwiseOR(F.shiftleft(letter(2), BITS)).bitwiseOR(letter(3))


def terms_hit(postings: DataFrame, terms: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """``term, id, tf`` for terms (``term``, in lower case, distinct, of two characters or more): the rows that hold each,
    and how often, overlaps included. ``current`` (``id, mark``) has the rows' latest marks."""
    long_terms = terms.where(F.length("term") >= RUN)
    last = F.length("term") - RUN
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(RUN)), F.array(last)))
    asked = long_terms.select("term", F.explode(offsets).alias("offset"))
    asked = asked.select("term", "offset", _gram(F.col("term").substr(F.col("offset") + 1, F.lit(RUN))).alias("gram"))
    pair = F.shiftright(_gram(F.concat("term", F.lit("\n"))), BITS)
    short = terms.where(F.length("term") == 2).select("term", pair.alias("pair"))
    rows = postings
    few, shorts = asked.select("gram").distinct().limit(MOST_RUNS + 1).collect(), short.limit(MOST_RUNS + 1).collect()
    begins = F.shiftright("gram", BITS)
    if len(few) + len(shorts) <= MOST_RUNS:
        # numbers in the filter reach the scan, which skips files and row groups without them
        wanted = F.col("gram").isin([r.gram for r in few]) if few else F.lit(False)
        for r in shorts:
            wanted |= F.col("gram").between(r.pair << BITS, (r.pair + 1 << BITS) - 1)
        rows = rows.where(wanted)
    else:
        met = rows.join(asked.select("gram").distinct(), "gram", "left_semi")
        more = rows.withColumn("pair", begins).join(short.select("pair").distinct(), "pair", "left_semi").drop("pair")
        rows = met.unionByName(more.join(asked.select("gram").distinct(), "gram", "left_anti"))
    if current is not None:
        rows = rows.join(current, ["id", "mark"], "left_semi")
    rows = durable(rows.select("gram", "id", "places"))
    common = rows.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = asked.join(common, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = ranked.groupBy("term").agg(F.min_by(F.struct("gram", "offset"), F.struct("df", "offset")).alias("r"), F.count("*").alias("runs"))
    rarest = rarest.select("term", "r.gram", "r.offset", "runs")
    moved = F.transform("places", lambda p: p - F.col("offset"))
    began = rarest.join(rows, "gram").select("term", "id", moved.alias("starts"), "runs")
    single = began.where("runs = 1").select("term", "id", F.size("starts").cast("long").alias("tf"))
    others = asked.join(rarest.select("term", F.col("offset").alias("_begun")), "term").where("offset != _begun").drop("_begun")
    checked = began.where("runs > 1").join(others, "term").join(rows, ["gram", "id"]).select("term", "id", "starts", "runs", moved.alias("more"))
    both = checked.groupBy("term", "id", "runs").agg(F.first("starts").alias("starts"), F.collect_list("more").alias("all"))
    both = both.where(F.size("all") == F.col("runs") - 1)
    left = F.aggregate("all", F.col("starts"), lambda have, more: F.array_intersect(have, more))
    several = both.select("term", "id", F.size(left).cast("long").alias("tf")).where("tf > 0")
    two = rows.withColumn("pair", begins).join(short, "pair").groupBy("term", "id").agg(F.sum(F.size("places")).alias("tf"))
    return single.unionByName(several).unionByName(two.select("term", "id", F.col("tf").cast("long")))


@dataclass
class Index:
    """The index of a store, as questions use it: ``rows`` is how many rows it knows, ``mean`` their mean size."""

    postings: DataFrame
    sizes: DataFrame
    rows: int
    mean: float

    def hits(self, terms: DataFrame) -> DataFrame:
        """``term, id, tf, size`` of the rows that hold a term."""
        found = terms_hit(self.postings, terms, self.sizes.select("id", "mark"))
        return found.join(self.sizes.select("id", "size"), "id")


def index_of(memories: DataFrame) -> Index:
    """An index made for the occasion, for a store that has none."""
    sizes = durable(memories.select("id", size_of().alias("size"), F.lit(0).cast("long").alias("mark")))
    rows, mean = sizes.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    return Index(postings_of(memories).withColumn("mark", F.lit(0).cast("long")), sizes, rows, mean)


def open_index(postings: DataFrame, sizes: DataFrame, memories: DataFrame) -> Index | None:
    """The index, if it knows all rows of the store; none for a store that was written in another way."""
    newest = sizes.groupBy("id").agg(F.max("mark").alias("mark"), F.max_by("size", "mark").alias("size"))
    rows, mean = newest.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    return Index(postings, newest, rows, mean) if rows and rows == memories.count() else None
