"""Cutting transcripts into segments and windows."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.ranking import running_sum

State = TypeVar("State")

LINE_CHARS = 8192
WINDOW_CHARS, LEAST_WINDOW = 8000, 200


def capped(line: Column) -> Column:
    """A line as it enters a transcript: cut, with a mark, beyond 8192 characters."""
    return F.when(F.length(line) > LINE_CHARS, F.concat(F.substring(line, 1, LINE_CHARS), F.lit("…"))).otherwise(line)


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[dict], State], step: Callable[[State, dict], tuple[State, tuple]]) -> DataFrame:
    """A fold over each key's rows in order, where a row's result depends on all before it.

    Rows stream through a task sorted, and only one state is held, so a key's length doesn't matter for
    memory, and time is in proportion to it. ``start`` and ``step`` get rows as dicts; ``step`` returns the
    next state and the row's results, which are appended to the key and order columns as ``schema`` says.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    head = rows.select(*keys, *order).schema
    whole = StructType([*head.fields, *StructType.fromDDL(schema).fields])
    arrow, kept = to_arrow_schema(whole), [*keys, *order]

    def run(batches):
        last, state = None, None
        for batch in batches:
            results = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if last is None or key != last:
                    last, state = key, start(row)
                state, result = step(state, row)
                results.append(result)
            columns = [batch.column(k) for k in kept] + [pa.array(c, arrow.field(len(kept) + i).type) for i, c in enumerate(zip(*results))]
            if results:
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, whole)


def greedy_segments(lines: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """``key, order, segment``: a segment ends with the record that brings its characters (one more
    for each line end) to ``most``.

    The sum starts anew after each end, so it is no prefix sum, and a session's sizes are folded in order.
    """

    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], tuple]:
        used, segment = state
        used += (row["_size"] or 0) + 1
        return ((0, segment + 1) if used >= most else (used, segment)), (segment,)

    rows = lines.select(key, order, F.col(size).cast("long").alias("_size"))
    return fold_sorted(rows, [key], [order], "segment long", lambda _: (0, 0), step)


def segment_texts(lines: DataFrame, segments: DataFrame, key: str, order: str, text: str, least: int) -> DataFrame:
    """``key, segment, text, skipped``: segments under ``least`` characters only move the offset."""
    rows = lines.join(segments, [key, order]).groupBy(key, "segment")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "\n")
    return rows.agg(whole.alias("text"), F.max(order).alias("through")).withColumn("skipped", F.length("text") < least)


def fixed_windows(texts: DataFrame, key: str, text: str, size: int = WINDOW_CHARS, least: int = LEAST_WINDOW) -> DataFrame:
    """``key, offset, window``: slices of ``size`` characters; nearly blank ones are left out."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    rows = texts.where(F.length(text) > 0).select(key, text, F.explode(starts).alias("_i"))
    window = F.substring(F.col(text), F.col("_i") * size + 1, F.lit(size))
    return rows.select(key, (F.col("_i") * size).cast("long").alias("offset"), window.alias("window")).where(F.length(F.trim("window")) >= least)


def within_budget(windows: DataFrame, lens: str, order: list[str], chars: str, nightly: int) -> DataFrame:
    """Windows that a night still takes: one goes as long as what went before is under ``nightly``."""
    return running_sum(windows, [lens], order, chars, "_before").where(F.col("_before") < nightly).drop("_before")


def resume_at(size: Column, processed: Column, first_cap: int | None = None) -> Column:
    """Where reading goes on: at the start of a file that shrank; a new file's last ``first_cap`` bytes."""
    new = F.lit(0).cast("long") if first_cap is None else F.greatest(F.lit(0).cast("long"), size - first_cap)
    return F.when(processed.isNull(), new).when(size < processed, F.lit(0).cast("long")).otherwise(processed)
