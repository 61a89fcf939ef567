"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.deploy import durable, ship

__all__ = ["bounded", "durable", "map_rows", "pick", "release", "settle", "ship", "table", "to_batch"]

#: Output rows are handed to Spark in batches of about this many bytes.
FLUSH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, also where others differ only by case."""
    seen = Counter(c.lower() for c in df.columns)
    if all(seen[n.lower()] == 1 for n in names):
        return df.select(*(F.col(f"`{n}`") for n in names))
    places = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*places).select(*(F.col(places[df.columns.index(n)]).alias(n) for n in names))


def bounded(spark: SparkSession) -> SparkSession:
    """Hand rows to Python in batches of 2000 instead of 10,000, as whole texts are large.

    A session that has its own batch size keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")
    return spark


def release() -> None:
    """Give memory that a task has freed back to the system; workers live longer than tasks. Arrow's memory
    is taken from the system's allocator from then on, as others keep what was freed."""
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def settle(spark: SparkSession) -> None:
    """Let executors drop broadcasts of what is done. Spark tells them when the driver's garbage is collected, for
    which it has a timer of half an hour; a pipeline's stages come faster."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_rows(
    df: DataFrame,
    schema: str,
    arrow: pa.Schema,
    rows: Callable[[Iterator[dict[str, list]]], Iterable[tuple]],
    size: Callable[[tuple], int] = lambda row: 64,
    done: Callable[[], None] = lambda: None,
    as_arrow: tuple[str, ...] = (),
) -> DataFrame:
    """``mapInArrow`` for functions from columns of Python values, or of ``as_arrow`` as Arrow's arrays, to output tuples.

    Output goes out in batches of about ``FLUSH_BYTES``, so that memory stays bounded
    whatever the texts' lengths. ``done`` is called at a task's end, to empty tables.
    """

    def run(batches):
        def columns():
            for batch in batches:
                yield {n: c if n in as_arrow else c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}

        held: list[tuple] = []
        weight = 0
        for row in rows(columns()):
            held.append(row)
            weight += size(row)
            if weight >= FLUSH_BYTES:
                yield to_batch(held, arrow)
                held, weight = [], 0
        if held:
            yield to_batch(held, arrow)
        held = []
        done()
        release()

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema
    )
