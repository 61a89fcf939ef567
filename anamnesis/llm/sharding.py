"""Sharding by longest-processing-time scheduling.

Rows with equal texts form groups that must stay together. All groups, largest first, go to
the least-loaded shard, which a heap gives.

Scale: groups of one size are alike, so the schedule is made by size: of each, how many
groups every shard gets (``spread``). One task reads sizes and their counts, largest first, as
a stream, and holds the shards' loads alone; n bytes can hold at most the square root of 2n
different sizes, so that stream stays short (a task for it all, but not one that grows
with the rows). The groups of a size are numbered in cells of about ``CELL``, and a
group's number says which shard it goes to; no task sees all groups of a common size.
Groups with over 1 / ``HOT`` of all rows, of which there are fewer than ``HOT``, are broadcast to
their rows, so that a hot text isn't joined in one task. A row's slot is a running number
in its cell (shard and salt) plus the rows of the shard's earlier cells.

Defined cases: a null text has no bytes and forms a group with other null texts; texts of any
length count by their bytes; groups of equal size take their turns in the order of a hash, and
of equally loaded shards the first is next; repeated rows stay together with their group and
have slots of their own, in the order of ids; an empty table gives an empty result; columns
besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import durable, pick

ROW_BYTES = 16
CELL = 20_000
HOT = 1000


def spread(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` items of one size each shard gets, item by item to the least loaded (the
    first of equals); ``loads`` are brought up to date."""
    counts = [0] * len(loads)
    if n > 2 * len(loads):
        # an item goes to a shard at a load up to v before any goes to one at more, so all items below
        # the highest such v that n suffices for are dealt at once
        low, high = min(loads) - 1, min(loads) + size * n
        while low < high:
            v = (low + high + 1) // 2
            if sum((v - load) // size + 1 for load in loads if load <= v) <= n:
                low = v
            else:
                high = v - 1
        counts = [(low - load) // size + 1 if load <= low else 0 for load in loads]
        n -= sum(counts)
        loads[:] = [load + size * k for load, k in zip(loads, counts)]
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(n):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        loads[shard] += size
        counts[shard] += 1
    return counts


def longest_first(sizes: dict[int, int], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each size, largest first, how many of its groups every shard gets. ``sizes``: groups by size."""
    loads = [0] * shards
    for size, n in sorted(sizes.items(), reverse=True):
        yield size, spread(loads, size, n)


def _schedule(shards: int):
    one = pa.list_(pa.struct([("end", pa.int64()), ("shard", pa.int32())]))

    def run(batches):
        loads = [0] * shards
        for batch in batches:
            sizes, ends = batch.column(0).to_pylist(), []
            for size, n in zip(sizes, batch.column(1).to_pylist()):
                end, mine = 0, []
                for shard, k in enumerate(spread(loads, size, n)):
                    if k:
                        end += k
                        mine.append({"end": end, "shard": shard})
                ends.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(ends, one)], names=["bytes", "ends"])

    return run


def _firsts(cells: DataFrame, of: str) -> DataFrame:
    """``cells`` (``of, salt, n``) with ``first``, the rows in earlier cells."""
    before = Window.partitionBy(of).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def _salt(key: Column, rows: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows // CELL)))).cast("int")


def placed_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``grp, members, shard`` of groups ``grp, bytes, members``. ``groups`` should be read from storage."""
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    # repartition(1) for the order of the stream: sizes and counts only
    plan = sizes.repartition(1).sortWithinPartitions(F.desc("bytes")).mapInArrow(_schedule(shards), "bytes long, ends array<struct<end: long, shard: int>>")
    salted = groups.withColumn("salt", _salt(F.col("grp"), groups.count()))
    cells = _firsts(salted.groupBy("bytes", "salt").agg(F.count("*").alias("n")), "bytes")
    place = Window.partitionBy("bytes", "salt").orderBy("grp")
    numbered = salted.withColumn("at", F.row_number().over(place) - 1).join(cells.join(plan, "bytes"), ["bytes", "salt"])
    number = F.col("first") + F.col("at")
    mine = F.get(F.filter("ends", lambda e: e["end"] > number), F.lit(0))
    return numbered.select("grp", "members", mine["shard"].alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    text = F.coalesce("text", F.lit(""))
    rows = durable(
        pick(docs, id_col, text_col)
        .toDF("id", "text")
        .select(
            F.col("id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), "text"), F.lit("null")), 256), 1, 32)).alias("grp"),
        )
    ).withColumn("_row", F.monotonically_increasing_id())
    groups = durable(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("members")))
    total = groups.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    shard_of = durable(placed_groups(groups, shards))
    hot = F.col("members") * HOT > total
    known = rows.join(F.broadcast(shard_of.where(hot).select("grp", F.col("shard").alias("own"))), "grp", "left")
    placed = (
        known.where("own IS NULL").drop("own").join(shard_of.where(~hot).select("grp", "shard"), "grp")
        .unionByName(known.where("own IS NOT NULL").withColumnRenamed("own", "shard"))
        .withColumn("salt", F.pmod("_row", F.lit(max(1, -(-total // (shards * CELL))))).cast("int"))
    )
    cells = _firsts(placed.groupBy("shard", "salt").agg(F.count("*").alias("n")), "shard")
    inside = Window.partitionBy("shard", "salt").orderBy("doc_id", "_row")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(cells, ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))
    )
