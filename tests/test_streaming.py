"""Streams give what their batch forms give."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from anamnesis.streaming import live


def test_landing_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pushes = [
        {"machine": "m", "agent": "pi", "uid": "u", "from_line": 0, "lines": ["a", "b\nc"], "at": "2024-01-01T00:00:00Z"},
        {"machine": "m", "agent": "pi", "uid": "u", "from_line": 0, "lines": ["a", "b\nc"], "at": "2024-01-01T01:00:00Z"},
        {"machine": "m", "agent": "pi", "uid": "u", "from_line": 2, "lines": ["d"], "at": "2024-01-01T02:00:00Z"},
        {"machine": "m", "agent": "nobody", "uid": "u", "from_line": 9, "lines": ["x"], "at": "2024-01-01T02:00:00Z"},
    ]
    for i, p in enumerate(pushes):
        (folder / f"{i}.json").write_text(json.dumps(p))
    live.land(live.pushes(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.machine, r.uid, r.line_no, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = live.batch_lines(spark.read.schema(live.PUSH).json(str(folder)))
    assert got == {(r.machine, r.uid, r.line_no, r.value) for r in batch.collect()} == {("m", "u", 0, "a"), ("m", "u", 1, "b c"), ("m", "u", 2, "d")}


def test_ledger_and_activity(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    rows = [("c1", "m:1", "2024-01-01T00:00:00Z"), ("c1", "m:1", "2024-01-01T05:00:00Z"), ("c2", "m:1", "2024-01-01T06:00:00Z")]
    (folder / "a.json").write_text("\n".join(json.dumps({"conversation": c, "item": i, "at": t, "category": "recall", "req_bytes": 2}) for c, i, t in rows))
    stream = spark.readStream.schema("conversation string, item string, at timestamp, category string, req_bytes long").json(str(folder))
    live.fresh_injections(stream).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("fresh").count() == 2
    live.live_activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("activity").select("n", "req_bytes").first() == (3, 6)
    assert spark.table("activity").agg(F.count("*")).first()[0] == 1


def test_the_ledger_lets_go_of_silent_conversations(spark, tmp_path):
    """Over several runs: state is kept between them, expires by the watermark, and a reset clears it."""
    key, store = live.STATE_STORE
    own = spark.conf.get(key)
    spark.conf.set(key, store)
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def arrive(name, *rows):
        (folder / name).write_text("\n".join(json.dumps({"conversation": c, "item": i, "at": f"2024-01-{t}:00:00Z", "reset": i is None}) for c, i, t in rows))
        stream = spark.readStream.schema("conversation string, item string, at timestamp, reset boolean").json(str(folder))
        fresh = live.fresh_with_resets(stream, late="1 hour")
        fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.conversation, r.item, r.at.day, r.at.hour) for r in spark.read.parquet(out).collect())

    try:
        first = arrive("a.json", ("c", "m:1", "01T00"), ("c", "m:1", "01T05"), ("d", "m:1", "01T06"))
        assert [x[:2] for x in first] == [("c", "m:1"), ("d", "m:1")]
        assert arrive("b.json", ("c", "m:1", "02T23"), ("d", None, "02T23"), ("e", "m:2", "02T23")) == sorted([*first, ("e", "m:2", 2, 23)])
        again = arrive("c.json", ("c", "m:1", "03T01"), ("d", "m:1", "03T00"))
        assert len(again) == 5 and ("c", "m:1", 3, 1) in again and ("d", "m:1", 3, 0) in again
        arrive("d.json", ("f", "m:9", "20T00"))
        left = spark.read.format("statestore").option("path", check).option("stateVarName", "had").load().select("key.*").collect()
        assert {r[0] for r in left} == {"f"}
    finally:
        spark.conf.set(key, own)


def test_pushes_are_aligned(spark, tmp_path):
    """Over runs: replays land once, a gap is told and filled later, a session that was written anew starts again."""
    key, store = live.STATE_STORE
    own = spark.conf.get(key)
    spark.conf.set(key, store)
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def arrive(name, *pushes):
        rows = [{"machine": "m", "agent": "pi", "uid": u, "from_line": n, "lines": lines, "at": f"2024-01-01T{h:02}:00:00Z"} for h, (u, n, lines) in enumerate(pushes)]
        (folder / name).write_text("\n".join(map(json.dumps, rows)))
        stream = live.aligned(live.pushes(spark, str(folder)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.uid, r.generation, r.line_no, r.value or "", r.note or "") for r in spark.read.parquet(out).collect())

    try:
        first = arrive("a.json", ("u", 0, ["a", "b"]), ("u", 1, ["b", "c"]), ("u", 5, ["f"]), ("v", 2, ["late"]), ("", 0, ["x"]), ("w", 0, []))
        lines = [("u", 0, 0, "a", ""), ("u", 0, 1, "b", ""), ("u", 0, 2, "c", "")]
        assert first == sorted([*lines, ("u", 0, 3, "", "gap"), ("v", 0, 0, "", "gap")])
        second = arrive("b.json", ("u", 0, ["a", "b", "c"]), ("u", 3, ["d", "e", "f"]), ("v", 0, ["x", "y"]), ("v", 2, ["late"]))
        assert second == sorted([*first, ("u", 0, 3, "d", ""), ("u", 0, 4, "e", ""), ("u", 0, 5, "f", ""), ("v", 0, 0, "x", ""), ("v", 0, 1, "y", ""), ("v", 0, 2, "late", "")])
        third = arrive("c.json", ("u", 0, ["new", "words"]), ("u", 2, ["more"]))
        assert third == sorted([*second, ("u", 1, 0, "", "restart"), ("u", 1, 0, "new", ""), ("u", 1, 1, "words", ""), ("u", 1, 2, "more", "")])
    finally:
        spark.conf.set(key, own)


def test_lines_a_million_apart_are_others(spark, tmp_path):
    """Places of the second lot of pushes that the first one's have too."""
    from anamnesis.catalogue import QUERIES

    rows = [(i, 7, "view") for i in (5, 1_000_005, 2_000_005)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.uid, r.line_no, r.value) for r in QUERIES["streamed_lines"](spark, str(tmp_path)).collect())
    assert got == sorted([("7", i, "view") for i, *_ in rows] + [("7", i + 1_000_000, "two words") for i, *_ in rows])


class _State:
    """Map state and timers in memory, with a count of calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "iterator": lambda: iter([*self.values.items()]), "containsKey": lambda k: k in self.values, "getValue": lambda k: self.values[k],
                "updateValue": self.values.__setitem__, "removeKey": self.values.pop, "clear": self.values.clear,
                "listTimers": lambda: iter([*self.timers]), "deleteTimer": self.timers.remove, "registerTimer": self.timers.add,
            }[name](*args)

        return call


@pytest.mark.parametrize("seed", range(6))
def test_the_ledger_asks_its_state_by_item(seed):
    """Over batches with resets, what going through records one by one gives; calls don't grow with records."""
    r, hours = random.Random(seed), 48
    state, ledger, had, got, want = _State(), live.Ledger(hours), {}, [], []
    ledger.init(state)
    for batch in range(3):
        times = [batch * 20 * 86_400_000_000 + r.randrange(25 * 24) * 3_600_000_000 + r.randrange(3) * 400 for _ in range(3000)]
        rows = [(None, t, True) if r.random() < seed / 2000 else (r.choice(["a", "b", "c"]), t, False) for t in times]
        for item, t, reset in sorted(rows, key=lambda x: (x[1], x[2], x[0] or "")):
            if reset:
                had.clear()
            elif item not in had or t // 1000 - had[item] > hours * 3_600_000:
                had[item] = t // 1000
                want.append((item, t))
        frame = pd.DataFrame(rows, columns=["item", "at", "reset"]).assign(at=lambda x: x["at"].to_numpy("int64").view("datetime64[us]"))
        for out in ledger.handleInputRows(("c",), iter([frame[:1000], frame[1000:]]), None):
            got += [(i, t.value // 1000) for i, t in zip(out["item"], out["at"])]
    assert sorted(got) == sorted(want) and {k: v for (k,), (v,) in state.values.items()} == had
    assert state.timers == {min(had.values()) + hours * 3_600_000 + 1} and state.calls < 60
