"""Running numbers and sums without a single task, and unions in which the first channel wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.deploy import durable

#: Bits that a row's place in its partition takes in ``monotonically_increasing_id``.
PLACE_BITS = 33


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted over all partitions by ``order``, with ``_part`` and ``_at``, a row's partition and its
    place there. It is checkpointed, as both must not change."""
    # the order of equal rows is settled before the checkpoint, once
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    inside = F.lit((1 << PLACE_BITS) - 1)
    return durable(
        placed.withColumns({"_part": F.shiftright("_id", PLACE_BITS).cast("int"), "_at": F.col("_id").bitwiseAND(inside)}).drop("_id")
    )


def numbered(df: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of ``by``; equal rows get numbers too, in some order.

    Rows are dealt to partitions by ranges. Only a count of each partition, of which there are as many as
    the session's settings say, reaches the driver.
    """
    rows = in_ranges(df, *by)
    first, firsts = 1, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").agg(F.count("*")).collect()):
        firsts.append((part, first))
        first += n
    starts = df.sparkSession.createDataFrame(firsts, "_part int, _first long")
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the earlier rows with the same keys.

    Rows are dealt by ranges of keys and order, and summed in cells, a key's rows in one partition; only
    the cells' sums are summed over a key, so a key with most of the rows is spread over many tasks.
    """
    rows = in_ranges(df, *keys, *order)
    cell = [*keys, "_part"]
    sums = rows.groupBy(*cell).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*cell).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cell]
    joined = rows.alias("r").join(sums.alias("s"), same)
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("r._inside") + F.col("s._before")).alias(name))


def union_first(channels: list[DataFrame], key: str) -> DataFrame:
    """The union of channels with the same columns, of rows with equal keys the first channel's.
    Adds ``channel``, its number."""
    out = None
    for number, df in enumerate(channels):
        df = df.withColumn("channel", F.lit(number))
        out = df if out is None else out.unionByName(df)
    first = Window.partitionBy(key).orderBy("channel")
    return out.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
