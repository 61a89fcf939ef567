"""The state machine against a plain interpreter, snapshots, and the cases that the blueprint names."""

import os
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from anamnesis import fixtures as X
from anamnesis import snapshots
from anamnesis.functions import text as T
from anamnesis.operators import conversations as C
from anamnesis.operators import merging as M
from anamnesis.operators import selection as S
from anamnesis.operators import upkeep as U
from anamnesis.operators.ranking import numbered, running_sum
from anamnesis.plans import recall as R
from anamnesis.schema import TABLES, conform
from anamnesis.snapshots import SnapshotStore



def at():
    return F.lit("2024-07-01 00:00:00").cast("timestamp")


ACTIONS = (
    "seq long, action string, target_id long, owner string, cwd string, kind string, domain string, summary string, content string,"
    " keywords array<string>, origin string, confidence double, source string"
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def memory(spark, rows):
    return conform(spark.createDataFrame(rows, "id long, content string, origin string, confidence double"), "memories")


def interpret(rows, actions, blocked):
    """The batch, action by action."""
    store = {r[0]: dict(id=r[0], content=r[1], origin=r[2], confidence=r[3], evidence=1, status="active", by=None) for r in rows}
    born = []
    for a in sorted(actions):
        seq, kind, target, content, origin, confidence = a
        old = store.get(target)
        if kind == "NEW":
            if content not in blocked:
                born.append((seq, content, None))
        elif kind == "REINFORCE":
            old["evidence"] += 1
            old["confidence"] = min(1.0, old["confidence"] + 0.05)
        elif kind == "REFINE":
            old["evidence"] += 1
            old["content"] = content
        elif old["origin"] == "user_stated" and old["confidence"] >= 0.8 and not (origin == "user_stated" and confidence >= 0.8):
            old["evidence"] += 1
            old["confidence"] = min(1.0, old["confidence"] + 0.05)
        elif content not in blocked:
            born.append((seq, content, target))
            old["status"] = "superseded"
            old["by"] = seq
    first = max(store) + 1
    ids = {seq: first + n for n, (seq, _, _) in enumerate(sorted(born))}
    old = {(r["id"], r["content"], round(r["confidence"], 9), r["evidence"], r["status"], ids.get(r["by"])) for r in store.values()}
    return old, {(ids[s], c) for s, c, _ in born}


@pytest.mark.parametrize("seed", range(3))
def test_actions_equal_a_sequential_interpreter(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"text {i}", r.choice(["user_stated", "agent_inferred"]), r.choice([0.5, 0.75, 0.8, 0.95])) for i in range(1, 13)]
    blocked = {"new 3", "new 7", "new 11"}
    actions = []
    for seq in range(1, 60):
        kind = r.choice(["NEW", "REINFORCE", "REFINE", "SUPERSEDE"])
        target = None if kind == "NEW" else r.randint(1, 12)
        actions.append((seq, kind, target, f"new {seq % 13}", r.choice(["user_stated", "agent_inferred"]), r.choice([0.7, 0.9])))
    want_old, want_new = interpret(rows, actions, blocked)
    frame = spark.createDataFrame([(s, k, t, "default", None, "fact", None, "s", c, ["k"], o, f, "src") for s, k, t, c, o, f in actions], ACTIONS)
    stones = M.tombstones_of(memory(spark, [(900 + i, b, "mixed", 0.1) for i, b in enumerate(blocked)]), "x", at())
    after, log = M.apply_actions(memory(spark, rows), frame, stones, at())
    got = after.select("id", "content", F.round("confidence", 9), "evidence", "status", "superseded_by").collect()
    assert {tuple(x) for x in got if x[0] <= 12} == want_old
    assert {(x[0], x[1]) for x in got if x[0] > 12} == want_new
    assert log.count() == len(want_new)


def test_a_hot_target(spark):
    """Thousands of actions on one row, in windows and sums."""
    rows = memory(spark, [(1, "old", "user_stated", 0.7), (2, "other", "mixed", 0.5)])
    acts = [(n, "REINFORCE" if n % 3 else "SUPERSEDE", 1, "default", None, "fact", None, "s", f"c{n}", [], "agent_inferred", 0.9, None) for n in range(1, 3001)]
    after, log = M.apply_actions(rows, spark.createDataFrame(acts, ACTIONS), spark.createDataFrame([], TABLES["tombstones"]), at())
    row = after.where("id = 1").first()
    assert (row.status, row.evidence, row.confidence) == ("active", 3001, 1.0) and log.count() == 0


def test_reinforcement_closes_the_gate(spark):
    rows = memory(spark, [(1, "old", "user_stated", 0.75)])
    acts = [(1, "REINFORCE", 1, "default", None, "fact", None, "s", "c", [], "user_stated", 0.9, None), (2, "SUPERSEDE", 1, "default", None, "fact", None, "s", "c", [], "agent_inferred", 0.95, None)]
    after, _ = M.apply_actions(rows, spark.createDataFrame(acts, ACTIONS), spark.createDataFrame([], TABLES["tombstones"]), at())
    row = after.first()
    assert (row.status, row.evidence, round(row.confidence, 6)) == ("active", 3, 0.85)


@pytest.mark.parametrize(
    "old,new,allowed",
    [(("user_stated", 0.95), ("agent_inferred", 0.9), False), (("user_stated", 0.95), ("user_stated", 0.7), False), (("user_stated", 0.95), ("user_stated", 0.9), True), (("agent_inferred", 0.6), ("agent_inferred", 0.6), True)],
)
def test_gate(spark, old, new, allowed):
    assert one(spark, M.may_supersede(F.lit(old[0]), F.lit(old[1]), F.lit(new[0]), F.lit(new[1]))) is allowed


def test_digest_ignores_blanks_and_punctuation(spark):
    variants = ["Use the API, key!", "use　the api key", "USE THE API:KEY", "﻿use the api key。", "usetheapikey"]
    assert len({one(spark, T.digest(F.lit(v))) for v in variants}) == 1
    assert one(spark, T.digest(F.lit("é"))) == one(spark, T.digest(F.lit("é")))
    assert one(spark, T.digest(F.lit("other"))) != one(spark, T.digest(F.lit(variants[0])))


def test_tombstones_are_per_owner(spark):
    rows = memory(spark, [(1, "put away", "mixed", 0.5), (2, "  ", "mixed", 0.5)])
    stones = M.tombstones_of(rows, "archived", at())
    assert stones.count() == 1
    same = rows.withColumn("owner", F.lit("other"))
    assert M.without_tombstoned(same, stones).count() == 2
    assert [r.id for r in M.without_tombstoned(rows, stones).collect()] == [2]


def test_scrub(spark):
    text = "id LTAIabcdefghijkl12 sk-0123456789abcdefXY ghp_abcdefghij0123456789 github_pat_abcdefghij0123456789 access key=ABCDEFGHIJKLMNOPQRSTUVWX end"
    got = one(spark, T.scrub(F.lit(text)))
    assert got == "id [redacted-aliyun-ak] [redacted-sk] [redacted-ghp] [redacted-gh-pat] access key=[redacted-key] end"


def test_query_terms(spark):
    text = 'a "quoted phrase", 中文，检索 x_y 100% (ok) one two three four five six seven'
    want = ["quoted", "phrase", "中文", "检索", "x_y", "100%", "ok", "one", "two", "three", "four", "five"]
    assert one(spark, T.query_terms(F.lit(text))) == want == T.terms_of(text)


def test_envelope(spark):
    lines = ["**注入记忆 3 条**：", "1. #630 (fact) x", "**注入画像**：《y》", "（本对话已注入过的 6 条）_", "Use the above when it helps.", "mine", "he said 注入 here"]
    assert one(spark, T.strip_envelope(F.lit("\n".join(lines)))) == "mine\nhe said 注入 here"
    assert one(spark, T.strip_envelope(F.lit("1. #630 (fact) x"))) == "1. #630 (fact) x"


def test_numbered_is_dense_and_ordered(spark):
    rows = spark.range(0, 3000, 7).select((F.col("id") * 37).alias("k"))
    out = numbered(rows.repartition(7), "k")
    assert [r.number for r in out.orderBy("k").collect()] == list(range(1, 430))
    assert "Window" not in out._jdf.queryExecution().toString()
    same = numbered(rows.withColumn("k", F.lit(1)), "k")
    assert sorted(r.number for r in same.collect()) == list(range(1, 430))
    assert numbered(rows.limit(0), "k").count() == 0


def test_running_sum(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.randint(0, 9)) for i in range(900)]
    got = {x.i: x.s for x in running_sum(spark.createDataFrame(rows, "k string, i long, v long").repartition(5), ["k"], ["i"], "v", "s").collect()}
    sums = {}
    for k, i, v in rows:
        assert got[i] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v


def test_composition_is_asked_for_where_it_matters(spark):
    second = {chr(int(d.split()[1], 16)) for c in map(chr, range(0x110000)) if (d := unicodedata.decomposition(c)) and d[0] != "<" and " " in d}
    chars = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (c in second or not unicodedata.is_normalized("NFC", c))]
    rows = spark.createDataFrame([(c,) for c in chars], "c string")
    assert [x.c for x in rows.where(~F.col("c").rlike(T.COMPOSABLE)).collect()] == []
    assert one(spark, T.nfc(F.lit("e\u0301 \u1112\u1161\u11ab"))) == "\u00e9 \ud55c" and one(spark, T.nfc(F.lit(None).cast("string"))) is None


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", keep=2)
    assert store.read("memories").count() == 0
    rows = memory(spark, [(1, "a", "mixed", 0.5)])
    assert store.commit({"memories": rows}) == 1
    stones = M.tombstones_of(rows, "x", at())
    assert store.commit({"tombstones": stones}) == 2
    assert store.read("memories").count() == 1 and store.read("tombstones").count() == 1
    assert store.read("tombstones", 1).count() == 0
    store.commit({"memories": rows.limit(0)})
    assert store.versions() == [2, 3] and store.read("memories").count() == 0 and store.read("tombstones").count() == 1
    assert store.read("memories", 2).count() == 1


def test_two_writers(spark, tmp_path):
    """Of two that replaced a table the second is told, and the first one's version stays; what they don't both
    replace lands, whoever comes first."""
    one_, two = (SnapshotStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    row = lambda i, text: memory(spark, [(i, text, "mixed", 0.5)])
    one_.commit({"memories": row(1, "a")})
    base = two.newest()
    one_.commit({"memories": row(2, "winner")})
    with pytest.raises(RuntimeError, match="another writer"):
        two.commit({"memories": row(3, "loser")}, base=base)
    assert [r.content for r in one_.read("memories").collect()] == ["winner"] and one_.versions() == [1, 2]
    # rows to append go onto what came in the meantime, and so does another table
    base = two.newest()
    one_.append({"memories": row(4, "first")})
    two.commit({"tombstones": M.tombstones_of(row(9, "x"), "x", at())}, {"memories": row(5, "second")}, base)
    assert {r.content for r in one_.read("memories").collect()} == {"winner", "first", "second"} and one_.read("tombstones").count() == 1
    folders = {p.name for p in (tmp_path / "s" / "data").iterdir()}
    assert folders >= {f.split("/")[1] for fs in one_.manifest()["tables"].values() for f in fs}


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = SnapshotStore(spark, f"file://{tmp_path}/s", keep=50)
    store.commit({"memories": memory(spark, [(0, "t0", "mixed", 0.5)])})
    add = lambda i: SnapshotStore(spark, f"file://{tmp_path}/s", keep=50).append({"memories": memory(spark, [(i, f"t{i}", "mixed", 0.5)])})
    with ThreadPoolExecutor(4) as pool:
        versions = [*pool.map(add, range(1, 9))]
    assert sorted(versions) == [*range(2, 10)] and {r.id for r in store.read("memories").collect()} == {*range(9)}


def test_a_writer_that_died_stops_nobody(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.commit({"memories": memory(spark, [(1, "a", "mixed", 0.5)])})
    for left in ("_2.claim", "_abc.tmp"):
        (tmp_path / "s" / "manifests" / left).write_text("")
    assert store.commit({"memories": memory(spark, [(2, "b", "mixed", 0.5)])}) == 2 and store.newest() == 2


def test_touched_rows_stand_for_earlier_ones(spark, tmp_path, monkeypatch):
    """Against a plain dictionary, over appends, touches and rewrites of tables of many parts."""
    monkeypatch.setattr(snapshots, "COMPACT", 4)
    store, want, r = SnapshotStore(spark, f"file://{tmp_path}/s", keep=30), {}, random.Random(3)
    for step in range(14):
        new = {100 + step: f"new {step}"}
        old = {k: f"{want[k]} {step}" for k in r.sample(sorted(want), min(3, len(want)))} | {500 + step: "touched first"}
        table = lambda rows: memory(spark, [(k, v, "mixed", 0.5) for k, v in rows.items()])
        store.commit({}, {"memories": table(new)}, touched={"memories": table(old)})
        want |= new | old
        assert {x.id: x.content for x in store.read("memories").collect()} == want
        assert len(store.manifest()["tables"]["memories"]) <= 6
    assert {x.id for x in store.read("memories", 1).collect()} == {100, 500}
    assert store.read("memories").count() == len(want)


def test_locks(spark, tmp_path):
    one_, two = (SnapshotStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    with one_.locked(2000):
        time.sleep(3)  # it is renewed, so it isn't stale
        with pytest.raises(RuntimeError, match="lock"), two.locked(2000):
            pass
    file = tmp_path / "s" / "lock"
    assert not file.exists()
    sums = file.with_name(".lock.crc")
    file.write_text("someone who died")
    os.utime(file, (1, 1))
    with two.locked():
        held = file.read_text()
        sums.unlink(missing_ok=True)
        file.write_text("someone else")  # as if it had been taken over
    assert held != "someone else" == file.read_text()


def test_logs_make_no_versions(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.read("injection_log").count() == 0
    hours = lambda h: F.timestamp_micros(F.lit(int(h * 3_600_000_000)))
    for n, (talk, item, h) in enumerate([("c", "m:1", 100), ("c", "m:2", 101), ("d", "m:1", 101), ("c", None, 102), ("c", "m:2", 103), ("e", "m:9", 10)]):
        store.log("injection_log", spark.createDataFrame([(talk, item, n)], "conversation string, item string, mark long").withColumn("injected_at", hours(h)))
    assert store.versions() == []
    standing = C.standing_injections(store.read("injection_log"), hours(148.5))
    assert sorted((r.conversation, r.item) for r in standing.collect()) == [("c", "m:2"), ("d", "m:1")]
    assert C.standing_injections(store.read("injection_log"), hours(151)).where("conversation = 'd'").count() == 0


def test_old_layout_gets_defaults(spark):
    old = spark.createDataFrame([(1, "x", "short")], "id long, content string, summary string")
    row = conform(old, "memories").first()
    assert (row.keywords, row.status, row.evidence, row.absorbed_by) == ("", "active", 1, None)


def test_reorganise_phases(spark):
    rows = memory(spark, [(i, f"t{i}", "agent_inferred", 0.5 + i / 100) for i in range(1, 13)]).withColumn("last_seen", F.to_date(F.lit("2024-01-01")))
    merges = spark.createDataFrame([(1, "s", "c", ["k"], [1, 2, 99]), (2, "s", "c2", ["k"], [3]), (3, "s", "gone", ["k"], [4, 5])], "group_id long, summary string, content string, keywords array<string>, ids array<long>")
    conflicts = spark.createDataFrame([(6, 7), (8, 8), (6, 99)], "keep_id long, drop_id long")
    archives = spark.createDataFrame([(2,), (50,)], "id long")
    retags = spark.createDataFrame([(7, "nonsense", "d"), (8, "fact", "")], "id long, kind string, domain string")
    stones = M.tombstones_of(memory(spark, [(77, "gone", "mixed", 0.1)]), "x", at())
    changes, made, new = U.reorganise(rows, merges, conflicts, archives, retags, stones, "default", at())
    got = {r.id: (r.status, r.by_group, r.by_id, r.kind, r.domain) for r in changes.collect()}
    assert got == {
        1: ("superseded", 1, None, None, None),
        2: ("archived", 1, None, None, None),
        7: ("superseded", None, 6, None, "d"),
        8: (None, None, None, "fact", None),
    }
    assert [(r.group_id, r.evidence, r.members, round(r.confidence, 2)) for r in made.collect()] == [(1, 2, 2, 0.52)]
    assert [r.source_id for r in new.collect()] == [2]


def test_profiles_reactivate_and_keep_abstract(spark):
    old = spark.createDataFrame([(1, "default", "y", "t", "abs", "c", [1], "mature", "archived", 1, None)], "id long, owner string, theme string, title string, abstract string, content string, memory_ids array<long>, maturity string, status string, version long, parent_id long").withColumn("updated_at", at())
    new = spark.createDataFrame([("default", "y", "t2", " ".strip(), "c2", [1, 2], "mature", None)], "owner string, theme string, title string, abstract string, content string, memory_ids array<long>, maturity string, parent_id long")
    row = U.upsert_profiles(old, new, at()).first()
    assert (row.status, row.version, row.abstract, row.title) == ("active", 2, "abs", "t2")


def test_selection_order_and_scope(spark):
    rows = memory(spark, [(i, "x", "mixed", 0.5) for i in (1, 2, 3)])
    assert [(r.id, r.place) for r in S.by_ids(rows, spark.createDataFrame([*zip([3, 1, 3, 9], range(4))], "id long, position long")).orderBy("place").collect()] == [(1, 1), (3, 2)]
    assert one(spark, U.joined_members(F.array(F.lit(3), F.lit(1)).cast("array<long>"), F.array(F.lit(1), F.lit(2)).cast("array<long>"))) == [3, 1, 2]


@pytest.mark.parametrize("excavate,scope", [(False, "smart"), (True, "all")])
def test_many_questions_at_once(spark, sf, excavate, scope):
    """Each gets what it gets alone; a term that overlaps itself counts each time."""
    memories, as_of = X.memories(spark, sf), F.lit("2024-07-01").cast("date")
    texts = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    texts += ["", "de", "anan nan an", "zzzzz", None, texts[0]]
    questions = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question long, text string")
    got = {}
    for r in R.recall_many(memories, questions, as_of, 6, scope=scope, cwd="/p/src3", excavate=excavate).orderBy("question", F.desc("score"), "channel", "id").collect():
        got.setdefault(r.question, []).append((r.id, r.channel, round(r.score, 9)))
    for i, t in enumerate(texts):
        alone = R.fast_recall(memories, t or "", as_of, 6, scope=scope, cwd="/p/src3", excavate=excavate).collect()
        assert got.get(i, []) == [(r.id, r.channel, round(r.score, 9)) for r in alone], t
    assert R.recall_many(memories, questions.limit(0), as_of).count() == 0


def test_many_questions_leave_little_behind(spark, sf):
    """Without an index neither places nor pairs of rows and questions are written: what stays takes less than the texts."""
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if spark.sparkContext.getCheckpointDir() else None
    if folder is None:
        from anamnesis.deploy import durable

        durable(spark.range(1))
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    memories, before = X.memories(spark, sf), written()
    questions = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("question"), "text")
    R.recall_many(memories, questions, F.lit("2024-07-01").cast("date")).write.format("noop").mode("overwrite").save()
    assert written() - before < memories.agg(F.sum(F.octet_length("content"))).first()[0]
