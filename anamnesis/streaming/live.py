"""Streams: landing of pushed lines, the injection ledger, and live activity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from anamnesis.sources.sync import AGENTS, landed_lines

PUSH = "machine string, agent string, uid string, from_line long, lines array<string>, at timestamp"


def pushes(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Pushes as JSON files that arrive in a folder."""
    return spark.readStream.schema(PUSH).option("maxFilesPerTrigger", per_trigger).json(folder)


def land(stream: DataFrame, out: str, checkpoint: str, late: str = "48 hours") -> StreamingQuery:
    """Write each line of a session once, however often it is pushed within the time allowed.

    A line's place in its session is its identity, so a repeated push changes nothing.
    """
    rows = stream.where(F.col("agent").isin(*AGENTS) & (F.length("uid") > 0)).withWatermark("at", late)
    lines = rows.select("machine", "agent", "uid", "from_line", "at", F.posexplode("lines").alias("_i", "value"))
    lines = lines.select("machine", "agent", "uid", (F.col("from_line") + F.col("_i")).alias("line_no"), F.regexp_replace("value", "\n", " ").alias("value"), "at")
    once = lines.dropDuplicatesWithinWatermark(["machine", "uid", "line_no"])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("machine").trigger(availableNow=True).start()


ALIGNED = "machine string, uid string, generation int, line_no long, value string, at timestamp, note string"


class Alignment(StatefulProcessor):
    """How far each session of a machine has come: the next line, a digest of its first one, and its generation.

    A push that begins where the session ends, or before, gives its lines from there on, so a replay gives nothing again. One that
    begins later leaves a gap: it is noted with the line that the sender must go back to, and its lines aren't taken, so that
    what is stored has no holes. A push from line 0 whose first line differs from the stored one is a session that was
    written anew: its generation rises and its lines begin again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, first string, generation int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        place = self.place.get() if self.place.exists() else None
        after, first, generation = place or (0, None, 0)
        out = []
        note = lambda at, line, what: out.append((*key, generation, line, None, at, what))
        given = pd.concat([*rows]).sort_values(["at", "from_line"], kind="stable")
        for start, lines, at in zip(given["from_line"], given["lines"], given["at"]):
            lines = [] if lines is None else [*lines]
            if start < 0 or not lines:
                continue
            if start == 0:
                mark = hashlib.sha256((lines[0] or "").encode()).hexdigest()
                if first is not None and mark != first:
                    generation, after = generation + 1, 0
                    note(at, 0, "restart")
                first = mark
            if start > after:
                note(at, after, "gap")
                continue
            out += [(*key, generation, start + k, value, at, None) for k, value in enumerate(lines) if start + k >= after]
            after = max(after, start + len(lines))
        self.place.update((after, first, generation))
        yield pd.DataFrame(out, columns=["machine", "uid", "generation", "line_no", "value", "at", "note"])

    def close(self) -> None:
        pass


def aligned(stream: DataFrame) -> DataFrame:
    """Lines of pushes (``PUSH``) that follow on what their session has, once each, and notes of gaps and restarts
    (``note``, with the line to go back to). The session that starts the stream must have ``STATE_STORE``. A session's state is
    three values, and how many pushes a batch takes is the source's to limit."""
    rows = stream.where(F.col("agent").isin(*AGENTS) & (F.length("uid") > 0))
    keyed = rows.select(F.coalesce("machine", F.lit("")).alias("machine"), "uid", "from_line", "lines", "at")
    return keyed.groupBy("machine", "uid").transformWithStateInPandas(Alignment(), ALIGNED, "append", "None")


def fresh_injections(stream: DataFrame, hours: int = 48) -> DataFrame:
    """Items that a conversation hasn't had in the last 48 hours; ``stream`` has ``conversation, item, at``."""
    return stream.withWatermark("at", f"{hours} hours").dropDuplicatesWithinWatermark(["conversation", "item"])


class Ledger(StatefulProcessor):
    """What a conversation was given, as map state: an item and when it was last fresh. A record with ``reset`` clears the
    conversation. A timer of event time takes away what is over, so that a conversation that falls silent leaves no state."""

    def __init__(self, hours: int):
        self.ms = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.had = handle.getMapState("had", "item string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # of a row the item's number, the time and the mark are held; texts come in parts and go
        numbers: dict[str | None, int] = {}
        parts = []
        for part in rows:
            codes, items = pd.factorize(part["item"], use_na_sentinel=False)
            here = np.array([numbers.setdefault(None if pd.isna(i) else i, len(numbers)) for i in items], np.int32)
            parts.append((here[codes], part["at"].to_numpy("datetime64[us]").view(np.int64), part["reset"].to_numpy(bool)))
        codes, times, resets = map(np.concatenate, zip(*parts))
        had = {item: at for (item,), (at,) in self.had.iterator()}
        cleared = np.sort(times[resets])
        codes, times = codes[~resets], times[~resets]
        # a reset comes after items of the same moment
        era = np.searchsorted(cleared, times)
        order = np.lexsort((times, codes, era))
        codes, times, era = codes[order], times[order], era[order]
        names, changed, out = [*numbers], {}, []
        if len(cleared):
            self.had.clear()
        borders = np.flatnonzero((np.diff(era) != 0) | (np.diff(codes) != 0)) + 1
        for first, end in zip([0, *borders], [*borders, len(times)]) if len(times) else ():
            item, ms = names[codes[first]], times[first:end] // 1000
            last = had.get(item) if era[first] == 0 else None
            at = 0 if last is None else int(np.searchsorted(ms, last + self.ms, "right"))
            while at < len(ms):
                last = int(ms[at])
                out.append((key[0], item, times[first + at]))
                at = int(np.searchsorted(ms, last + self.ms, "right"))
                if era[first] == len(cleared):
                    changed[item] = last
        for item, last in changed.items():
            self.had.updateValue((item,), (last,))
        self._wake(changed if len(cleared) else had | changed)
        fresh = pd.DataFrame(out, columns=["conversation", "item", "at"])
        yield fresh.assign(at=pd.Series(fresh["at"].to_numpy(np.int64).view("datetime64[us]")))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        had = {item: at for (item,), (at,) in self.had.iterator()}
        for item in [i for i, at in had.items() if at + self.ms < passed]:
            self.had.removeKey((item,))
            del had[item]
        self._wake(had)
        yield pd.DataFrame([], columns=["conversation", "item", "at"])

    def _wake(self, had: dict[str | None, int]) -> None:
        """One timer, for when the oldest item is over."""
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if had:
            self.handle.registerTimer(min(had.values()) + self.ms + 1)

    def close(self) -> None:
        pass


#: The setting without which map state and timers aren't to be had, and its value.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fresh_with_resets(stream: DataFrame, hours: int = 48, late: str = "48 hours") -> DataFrame:
    """As ``fresh_injections``, with records that clear a conversation, as its compaction does (``reset``):
    ``conversation, item, at``. An item is fresh again more than ``hours`` after it last was. The session that starts the stream
    must have ``STATE_STORE``; what comes later than ``late`` after the newest is left out."""
    marked = stream.withColumn("reset", F.coalesce("reset", F.lit(False))).withWatermark("at", late)
    return marked.groupBy("conversation").transformWithStateInPandas(Ledger(hours), "conversation string, item string, at timestamp", "append", "eventTime")


def live_activity(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests by day and category as they come; ``stream`` has ``at, category, req_bytes``."""
    day = F.window("at", "1 day").start.alias("day")
    rows = stream.withWatermark("at", late).groupBy(day, "category")
    return rows.agg(F.count("*").alias("n"), F.sum("req_bytes").alias("req_bytes"))


def batch_lines(pushes_: DataFrame) -> DataFrame:
    """The batch form of ``land``."""
    rows = landed_lines(pushes_.where(F.col("agent").isin(*AGENTS) & (F.length("uid") > 0)))
    return rows.dropDuplicates(["machine", "uid", "line_no"])
