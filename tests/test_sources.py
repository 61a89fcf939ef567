"""Parsers, archives, slimming, pushes, segmentation and the nightly run."""

import gzip
import io
import json
import random
import struct
import tarfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anamnesis.operators.segments import greedy_segments, resume_at
from anamnesis.plans import dream
from anamnesis.plans.judge import DECISIONS, ReplayJudge, RuleJudge, first_json, numeric_ids
from anamnesis.plans.pick import deep_recall
from anamnesis.schema import conform
from anamnesis.snapshots import SnapshotStore
from anamnesis.sources import archives, inbox, records, sessions, sinks, sync

LINE = "path string, line_no int, value string, agent string"


def lines_of(spark, path, agent, values):
    rows = [(path, n, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False), agent) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, LINE)


def test_pi_parser(spark):
    values = [
        {"type": "session", "id": "s", "cwd": "/w"},
        {"type": "message", "message": {"role": "user", "content": "  hello\nthere "}},
        {"type": "message", "message": {"role": "assistant", "content": [
            {"type": "thinking", "thinking": "x"}, {"type": "text", "text": "fine"},
            {"type": "toolCall", "name": "ls", "arguments": {"path": "a" * 300}},
            {"type": "toolResult", "content": [{"type": "text", "text": "r" * 400}, {"type": "image"}]},
        ]}},
        "not json",
        {"type": "message", "message": {"role": "user", "content": "y" * 9000}},
    ]
    got = [r.line for r in sessions.parse_pi(lines_of(spark, "p", "pi", values)).orderBy("line_no", "part").collect()]
    assert got[:2] == ["[user] hello\nthere", "[assistant] fine"]
    assert got[2].startswith('[tool call] ls: {"path":"aaa') and len(got[2]) == len("[tool call] ls: ") + 201
    assert got[3] == f"[tool result] {'r' * 300}…"
    assert len(got[4]) == 8193 and got[4].endswith("…") and len(got) == 5
    assert sessions.session_cwd(lines_of(spark, "p", "pi", values)).first().cwd == "/w"


def test_claude_parser_and_unknown_agents(spark):
    values = [
        {"type": "user", "sessionId": "abcdefgh1", "message": {"role": "user", "content": "<command-name>x"}},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "user", "message": {"content": "kept"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_result", "content": "ok"}]}},
    ]
    all_lines = lines_of(spark, "c", "claude-code", values).unionByName(lines_of(spark, "x", "codex", ["{}"]))
    out, errors = sessions.parse(all_lines)
    assert [r.line for r in out.orderBy("line_no", "part").collect()] == ["[user] kept", '[tool call] Bash: {"command":"ls"}', "[tool result] ok"]
    assert [tuple(r) for r in errors.collect()] == [("x", "no parser for agent codex")]


def test_session_uids(spark):
    rows = [("claude-code", '{"sessionId": "12345678"}', "f"), ("pi", "{}", "a-long-stem-x"), ("pi", "{}", "short")]
    frame = spark.createDataFrame(rows, "agent string, first string, stem string")
    got = [r[0] for r in frame.select(sessions.session_uid(F.col("agent"), F.col("first"), F.col("stem"), F.lit("head"))).collect()]
    assert got[:2] == ["12345678", "a-long-stem-x"] and len(got[2]) == 32


def test_read_lines_leaves_an_unfinished_line(spark, tmp_path):
    (tmp_path / "subagents").mkdir()
    (tmp_path / "a.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":')
    (tmp_path / "subagents/b.jsonl").write_text('{"a":1}\n')
    assert [r.value for r in sessions.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ['{"a":1}', '{"a":2}']


def packed_zip(files, flags=0, method=8):
    out = b""
    for name, data in files:
        body = zlib.compress(data)[2:-4] if method else data
        out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, flags, method, 0, 0, 0, len(body), len(data), len(name), 0) + name.encode() + body
    return out


def test_archives(spark, tmp_path):
    text = ("【用户】hello there, this is a long enough line of talk\n" * 3).encode()
    whole = packed_zip([("a.txt", text), ("b.md", text), ("c.png", b"x" * 99)]) + packed_zip([("d.log", text)], method=0)
    (tmp_path / "w.zip").write_bytes(whole)
    (tmp_path / "cut.zip").write_bytes(packed_zip([("a.txt", text), ("b.md", text)])[:-5])
    (tmp_path / "flag.zip").write_bytes(packed_zip([("a.txt", text)]) + packed_zip([("b.txt", text)], flags=8))
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x/s.jsonl")
        body = b"\n".join(json.dumps({"type": "message", "message": {"role": r, "content": f"line {i} of a session that goes on"}}).encode() for i, r in enumerate(["user", "assistant"] * 3))
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    (tmp_path / "noext").write_bytes(text)
    got = inbox.slimmed(archives.read_drops(spark, str(tmp_path))).collect()
    names = sorted((r.path.rsplit("/", 1)[-1], r.entry, r.format) for r in got)
    assert names == [
        ("cut.zip", "a.txt", "text"), ("flag.zip", "a.txt", "text"), ("noext", "noext", "text"), ("t.tar.gz", "x/s.jsonl", "session-jsonl"),
        ("w.zip", "a.txt", "text"), ("w.zip", "b.md", "text"), ("w.zip", "d.log", "text"),
    ]
    session = next(r.text for r in got if r.format == "session-jsonl")
    assert session.startswith("【用户】line 0") and "\n\n【AI】line 1" in session
    assert list(archives.tar_entries(gzip.compress(b"broken"))) == []


def test_records():
    big = "z" * 60_000
    line = json.dumps({"type": "assistant", "toolUseResult": {"file": {"base64": big}}, "message": {"content": [
        {"type": "thinking", "thinking": big}, {"type": "image", "source": big}, {"type": "text", "text": big},
        {"type": "tool_use", "name": "Bash", "input": {"command": "c" * 900, "other": big}}, {"type": "tool_result", "content": "r" * 900},
    ]}})
    got = json.loads(records.slim_record(line, "claude-code"))
    parts = got["message"]["content"]
    assert parts[0] == {"type": "thinking", "stripped": True} and parts[1] == {"type": "image", "stripped": True}
    assert len(parts[2]["text"]) < 51_000 and "10000 chars dropped" in parts[2]["text"]
    assert parts[3]["input"] == {"command": "c" * 300} and parts[4]["truncated"] and len(parts[4]["content"]) == 500
    assert got["toolUseResult"] == {"type": "image", "stripped": True}
    assert records.slim_record("no json", "pi") == "no json" and records.slim_record(None, "pi") is None
    small = records.slim_record(json.dumps({"a": {"b": ["x" * 40_000, "y" * 30_000]}}), "pi", 20_000)
    assert len(small) <= 20_000 and json.loads(small)["a"]["b"][1].startswith("yyy")
    assert json.loads(records.slim_record('{"type":"file-history-snapshot","x":1}', "pi")) == {"type": "file-history-snapshot", "stripped": True}
    payload = {"payload": {"content": [{"type": "input_image", "image_url": "x"}], "note": big}, "content": [{"type": "image"}], "note": big}
    got = json.loads(records.slim_record(json.dumps(payload), "codex"))
    assert got["payload"]["content"] == [{"type": "image", "stripped": True}] and len(got["payload"]["note"]) < 51_000
    assert got["content"] == [{"type": "image"}] and got["note"] == big
    deep = json.dumps({"message": {"message": {"content": [{"type": "function_call", "name": "f", "arguments": "a" * 900}, {"type": "tool_use", "input": {"file_path": "p" * 400, "command": "c" * 400, "x": 1}}]}}})
    parts = json.loads(records.slim_record(deep, "pi"))["message"]["message"]["content"]
    assert parts[0] == {"type": "tool_use", "name": "f", "input": {"args": "a" * 300}} and parts[1]["input"] == {"file_path": "p" * 400, "command": "c" * 300}


@pytest.mark.parametrize("seed", range(5))
def test_records_are_cut_evenly(seed):
    r = random.Random(seed)
    record = {f"k{i}": "".join(r.choices('ab"\\\n', k=r.choice((10, 700, 5000)))) for i in range(12)}
    text = json.dumps(record, ensure_ascii=False, separators=(",", ":"))
    for most in (len(text), len(text) - 1, len(text) // 2):
        got = records.fitted(record, most)
        assert len(got) <= most
        if most < len(text) and got.startswith('{"k0"') and got.endswith('"}'):
            sizes = {k: len(v) for k, v in json.loads(got).items()}
            cut = {n for k, n in sizes.items() if n < len(record[k])}
            assert len(cut) == 1 and all(n <= cut.copy().pop() for n in sizes.values())
    assert len(records.fitted({f"k{i}": "x" * 400 for i in range(99)}, 2000)) == 2000
    # what is lost with the cut takes more in JSON than it has characters; it isn't made up for by a deeper cut
    for escaped in ("\n", '"\\', "\x01"):
        got = records.fitted({"note": "x" * 3000 + escaped + "y" * 3000, "more": "z" * 700 + escaped}, 3000)
        assert len(got) == 3000 and len(json.loads(got)["note"]) > len(json.loads(got)["more"])


def test_long_records_repeat_texts_as_their_sql_does(spark, tmp_path):
    """The number of repeats lies halfway between two."""
    import duckdb

    from anamnesis.catalogue import ORACLES, QUERIES

    spark.createDataFrame([(i, "abcdefgh"[i] * size) for i, size in enumerate((15, 31, 239, 383, 1919))], "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.slim for r in QUERIES["long_records"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLES["long_records"]).fetchall())



def test_untouched_lines_skip_python(spark):
    lines = ['{"a": 1,  "b": "kept as it came"}', json.dumps({"message": {"content": [{"type": "thinking", "thinking": "x"}]}}), None, "plain", "y" * 60_000]
    rows = spark.createDataFrame([(i, line, "pi") for i, line in enumerate(lines)], "i int, line string, agent string")
    got = [r[0] for r in rows.select("i", records.slimmed_record(F.col("line"), F.col("agent")).alias("s")).orderBy("i").select("s").collect()]
    assert got[0] == lines[0] and json.loads(got[1])["message"]["content"] == [{"type": "thinking", "stripped": True}] and got[2:] == lines[2:]


def test_pushes(spark):
    schema = "push long, machine string, agent string, uid string, from_line long, lines array<string>"
    rows = [(1, "m", "pi", "u", 2, ["c\nd"]), (2, "m", "pi", "u", 3, ["e"]), (3, "m", "pi", "v", 1, ["x"]), (4, "m", "bad", "w", 0, ["x"]), (5, "m", "pi", "u", 0, ["z"])]
    stored = spark.createDataFrame([("m", "u", 2)], "machine string, uid string, line_count long")
    good, bad = sync.accepted(spark.createDataFrame(rows, schema), stored)
    assert sorted(r.push for r in good.collect()) == [1, 2]
    assert sorted((r.push, r.reason, r.expected) for r in bad.collect()) == [(3, "offset", 0), (4, "unknown agent", 0), (5, "offset", 2)]
    assert sorted((r.line_no, r.value) for r in sync.landed_lines(good).collect()) == [(2, "c d"), (3, "e")]
    names = spark.createDataFrame([(n,) for n in ("ok-1.jsonl", "../x", "/abs", "C:x", "a/b", "a b", "", "x" * 201)], "n string")
    assert [r[0] for r in names.select(sync.safe_path(F.col("n"))).collect()] == ["ok-1.jsonl"] + [None] * 7


def test_segments_cover_every_line_once(spark):
    r = random.Random(5)
    rows = [(f"s{k}", n, r.randint(0, 400)) for k in range(6) for n in range(r.randint(1, 40))]
    got = {(x.s, x.n): x.g for x in greedy_segments(spark.createDataFrame(rows, "s string, n long, size long"), "s", "n", "size", 500).withColumnRenamed("segment", "g").collect()}
    assert len(got) == len(rows)
    used, segment, last = 0, 0, None
    for s, n, size in rows:
        if s != last:
            used, segment, last = 0, 0, s
        assert got[s, n] == segment
        used += size + 1
        if used >= 500:
            used, segment = 0, segment + 1


@pytest.mark.parametrize("size,processed,cap,want", [(100, None, None, 0), (100, None, 30, 70), (100, 40, None, 40), (30, 40, None, 0), (40, 40, None, 40)])
def test_resume(spark, size, processed, cap, want):
    done = F.lit(processed).cast("long")
    assert spark.range(1).select(resume_at(F.lit(size).cast("long"), done, cap)).first()[0] == want


def test_json_rescue(spark):
    assert first_json('Sure: ```json\n{"a": "}{", "b": [1]}\n``` done') == '{"a":"}{","b":[1]}'
    assert first_json("none {") is None
    got = spark.range(1).select(numeric_ids(F.array(F.lit("18"), F.lit("x"), F.lit("7"), F.lit("1.5")))).first()[0]
    assert got == [18, 7]


def test_nights(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    at, as_of = F.lit("2024-07-01 00:00:00").cast("timestamp"), F.lit("2024-07-01").cast("date")
    talk = [{"type": "message", "message": {"role": "user", "content": f"remember item {i}: " + "words " * 60}} for i in range(4)]
    first = lines_of(spark, "p1", "pi", talk).unionByName(lines_of(spark, "bad", "codex", ["{}"]))
    report = dream.run(store, first, RuleJudge(), at, as_of)
    assert report["version"] == 1 and report["actions"] == 1 and report["errors"] == 1
    assert store.read("memories").count() == 1
    again = dream.run(store, first, RuleJudge(), at, as_of)
    assert again["actions"] == 0 and store.read("memories").count() == 1
    assert {r.session_file for r in store.read("distill_state").collect()} == {"p1"}
    sessions.PARSERS["codex"] = sessions.parse_text  # a parser has come, and the file is read
    try:
        late = dream.run(store, first.where("path = 'p1'").unionByName(lines_of(spark, "bad", "codex", ["late words " * 40])), RuleJudge(), at, as_of)
    finally:
        del sessions.PARSERS["codex"]
    assert late["errors"] == 0 and late["actions"] == 1 and "bad" in {r.session_file for r in store.read("distill_state").collect()}
    assert {(r.session_uid[:6], r.path) for r in store.read("session_registry").collect()} >= {(store.read("session_registry").where("path = 'p1'").first().session_uid[:6], "p1")}
    memories, profiles = store.read("memories"), store.read("profiles")
    assert profiles.where("status = 'active'").count() >= 0 and memories.select("id").distinct().count() == memories.count()
    assert store.read("memory_log").where("action = 'error'").first().detail == "bad: no parser for agent codex"
    more = lines_of(spark, "p1", "pi", talk + talk)
    assert dream.new_lines(more, store.read("distill_state")).agg(F.min("line_no")).first()[0] == 4


def test_deep_recall_replays_and_degrades(spark):
    rows = conform(spark.createDataFrame([(i, f"text {i}") for i in range(1, 6)], "id long, content string"), "memories")
    rows = rows.withColumns({"last_seen": F.to_date(F.lit("2024-06-01")), "summary": F.lit("s")})
    picks = spark.createDataFrame([(0, 4, None), (1, 99, None), (2, 2, None), (3, 4, None)], DECISIONS["pick"])
    as_of = F.lit("2024-07-01").cast("date")
    judge = ReplayJudge({"pick": picks})
    assert [r.id for r in deep_recall(rows, judge, "q", as_of).memories.collect()] == [4, 2]
    ledger = spark.createDataFrame([("m:4",)], "item string")
    assert [r.id for r in deep_recall(rows, judge, "q", as_of, ledger=ledger).memories.collect()] == [2]
    assert deep_recall(rows, judge, "q", as_of, ledger=ledger).deduped == 1

    class Broken:
        def decide(self, step, inputs):
            raise TimeoutError

    assert deep_recall(rows, Broken(), "text", as_of, k=3).memories.count() == 3


def test_two_decisions_on_one_candidate(spark, tmp_path):
    """Each makes a row of its own, and no id comes twice."""
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    at, as_of = F.lit("2024-07-01 00:00:00").cast("timestamp"), F.lit("2024-07-01").cast("date")
    talk = [{"type": "message", "message": {"role": "user", "content": "remember this: " + "words " * 80}}]

    class Twice(RuleJudge):
        def decide(self, step, inputs):
            out = super().decide(step, inputs)
            return out.unionByName(out.withColumn("content", F.concat("content", F.lit(" again")))) if step == "merge" else out

    assert dream.run(store, lines_of(spark, "p", "pi", talk), Twice(), at, as_of)["actions"] == 2
    rows = store.read("memories").orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2] and len({r.content for r in rows}) == 2


def test_a_night_with_everything(spark, tmp_path):
    """Dropped files, a curation plan, chapters, gists, cards and the lock."""
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    at, as_of = F.lit("2024-07-01 00:00:00").cast("timestamp"), F.lit("2024-07-01").cast("date")
    rows = [(i, "default", "lesson" if i % 2 else "fact", "dev" if i % 3 else "home", f"summary {i}", f"content {i} about things", "agent_inferred", 0.9, 1, "active") for i in range(1, 21)]
    memories = spark.createDataFrame(rows, "id long, owner string, kind string, domain string, summary string, content string, origin string, confidence double, evidence long, status string")
    memories = conform(memories, "memories").withColumn("last_seen_at", F.lit("2024-05-01").cast("timestamp"))
    replies = conform(spark.createDataFrame([(1, n, f"question {n} about gardening", f"answer {n} on gardening") for n in range(1, 10)], "topic_id long, reply_id long, query string, answer string"), "replies")
    topics = conform(spark.createDataFrame([(1, "c")], "topic_id long, conversation string"), "topics").withColumn("last_seen_at", at)
    store.commit({"memories": memories, "replies": replies, "topics": topics})
    plan = [
        ("merge", 1, [1, 2, 99], None, None, None, None, None, "merged", "one and two", ["k"]), ("conflict", 2, None, 3, 4, None, None, None, None, None, None),
        ("archive", 3, None, None, None, 5, None, None, None, None, None), ("retag", 4, None, None, None, 6, "preference", "garden", None, None, None),
    ]

    class Plan(RuleJudge):
        def decide(self, step, inputs):
            if step == "reorganize":
                return spark.createDataFrame(plan, DECISIONS[step])
            return super().decide(step, inputs)

    drops = spark.createDataFrame([("d/a.md", "a.md", "text", "User: hello there\nAssistant: hello, how are you\n" * 300), ("d/b.md", "b.md", "text", "no talk at all " * 20)], "path string, entry string, format string, content string")
    lines = lines_of(spark, "p", "pi", [])
    shown = []
    report = dream.run(store, lines, Plan(), at, as_of, drops=drops, kept_folder=f"{tmp_path}/kept", on_actions=lambda actions: shown.append(actions.count()))
    assert shown == [2]
    assert report["actions"] == 2
    after = {r.id: r for r in store.read("memories").collect()}
    assert len(after) == 23 and after[23].content == "one and two" and after[1].superseded_by == after[2].superseded_by == 23
    assert (after[4].status, after[4].superseded_by, after[5].status, after[6].kind, after[6].domain) == ("superseded", 3, "archived", "preference", "garden")
    assert store.read("tombstones").count() == 1
    files = {r.path: r for r in store.read("inbox_files").collect()}
    assert files["d/a.md!a.md"].status == "done" and files["d/b.md!b.md"].status == "skipped"
    assert spark.read.text(f"{tmp_path}/kept").count() == 2
    profiles = store.read("profiles").collect()
    roots = {r.id for r in profiles if r.parent_id is None}
    assert roots and all(r.parent_id in roots for r in profiles if r.parent_id is not None)
    taken = [r for r in after.values() if r.status == "absorbed"]
    assert all(r.absorbed_by in {p.id for p in profiles if p.maturity == "mature"} for r in taken) and taken
    told = store.read("replies").orderBy("reply_id").collect()
    assert told[0].gist == "answer 1 on gardening" and store.read("topics").first().summary.startswith("question 1") and store.read("topics").first().summary_at == 9
    kv = {r.key: r.value for r in store.read("kv").collect()}
    assert any(k.startswith("card:default:") and json.loads(v)["card"] for k, v in kv.items())
    lenses = spark.createDataFrame([("d/b.md!b.md", "plants"), ("d/b.md!b.md", "birds")], "path string, lens string")
    again = dream.run(store, lines, RuleJudge(), at, as_of, drops=drops, lenses=lenses)
    revived = store.read("inbox_files").where("path = 'd/b.md!b.md'").first()
    assert again["actions"] == 1 and (revived.status, sorted(revived.lens_offsets)) == ("done", ["birds", "plants"])
    assert store.read("profiles").count() >= len(profiles)
    with store.locked(), pytest.raises(RuntimeError, match="lock"):
        dream.run(store, lines, RuleJudge(), at, as_of)


def test_lines_of_files(spark, tmp_path):
    """Numbers and places hold across splits; a state in bytes reads what is new."""
    text = "".join(f'{{"n": {i}, "pad": "{"é" * (i % 50)}"}}\n' for i in range(900))
    (tmp_path / "a.jsonl").write_text(text + '{"open": ')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sessions.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    data = text.encode()
    assert [r.line_no for r in rows] == [*range(900)] and all(data[r.start :].startswith(r.value.encode() + b"\n") for r in rows)
    frame = sessions.read_lines(spark, str(tmp_path))
    path, state = rows[0].path, "session_file string, processed_bytes long"
    part = dream.new_lines(frame, spark.createDataFrame([(path, rows[500].start)], state))
    assert part.agg(F.min("line_no"), F.count("*")).first() == (500, 400)
    tail = dream.new_lines(frame, spark.createDataFrame([], state), 2000)
    assert tail.agg(F.min("start")).first()[0] >= rows[0].size - 2000 and 0 < tail.count() < 100
    assert sessions.read_lines(spark, str(tmp_path), modified_after="2999-01-01T00:00:00").count() == 0


def test_sessions_share_files(spark, tmp_path):
    """Files don't grow in number with sessions; each session's numbers hold across splits and files, whatever its name and texts."""
    names = [None, "", "a/b=c", "é\n", *(f"s{n}" for n in range(400))]
    want = [(s, i, f"{i} é\n\"x\"\t" * (1 + i % 5)) for n, s in enumerate(names) for i in range(1 + n % 7)]
    rows = spark.createDataFrame([(s, 10 * i - 3, v) for s, i, v in random.Random(4).sample(want, len(want))], "session string, line_no int, value string")
    files = "spark.sql.files."
    old = {k: spark.conf.get(k) for k in (f"{files}maxPartitionBytes", f"{files}maxRecordsPerFile")}
    spark.conf.set(f"{files}maxPartitionBytes", "4096")
    spark.conf.set(f"{files}maxRecordsPerFile", "5")
    try:
        sinks.write_sessions(rows, f"{tmp_path}/out")
        got = [tuple(r) for r in sessions.read_sessions(spark, f"{tmp_path}/out").select("session", "line_no", "value").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 0 < len([*(tmp_path / "out").rglob("*.txt")]) <= 4


def test_folds_are_linear(spark):
    rows = spark.range(400_000).select(F.lit("one").alias("s"), F.col("id").alias("n"), (F.col("id") % 97).alias("size"))
    out = greedy_segments(rows, "s", "n", "size", 5000)
    assert out.agg(F.max("segment")).first()[0] > 3000


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Files of 20 kB each come in parts of 16 MiB, not ten thousand at once."""
    from anamnesis.deploy import ship

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    files = ship(spark).range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).cast("binary").alias("content"))
    seen = [r.size for r in files.mapInArrow(sizes, "size long").collect()]
    assert max(seen) < 17 << 20 and len(seen) > 3
