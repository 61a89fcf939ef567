"""Jobs over given and growing input: what is taken once, what is replaced, and runs that are repeated."""

import hashlib
import json
import re
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import knowledge, registry, transcripts

ROOT = Path(__file__).resolve().parent.parent.parent
TURNS = "conv_id long, turn long, role string, text string"


def put(spark, rows, folder, schema=TURNS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def standing(spark, folder):
    return sorted(tuple(r) for r in transcripts.read(spark, str(folder)).collect())


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def places(tmp_path):
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")


def test_two_runs_over_growing_input(spark, places):
    source, out, mark = places
    put(spark, [(1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (2, 0, "USER", "other")], source)
    first = transcripts.run(spark, str(source), out, mark, 4, 500)
    assert first == {"batches": 1, "read": 3, "left_out": 0, "turns": 3, "contexts": first["contexts"]}
    before = files(out)
    # nothing new: nothing is read or written
    assert transcripts.run(spark, str(source), out, mark, 4, 500)["read"] == 0
    assert files(out) == before
    put(spark, [(1, 2, "user", "my key is sk-abcdefghijklmnop1234 ok"), (3, 0, "user", None), (None, 1, "user", "x"), (3, None, "user", "x")], source)
    second = transcripts.run(spark, str(source), out, mark, 4, 500)
    assert (second["read"], second["left_out"], second["turns"]) == (4, 2, 2)
    rows = {(r[0], r[1]): r for r in standing(spark, out)}
    assert {*rows} == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    said = "最近用户轮原文：\n0. hello there\n2. my key is [redacted-sk] ok"
    assert rows[1, 0][-1] == rows[1, 2][-1] == said and rows[1, 2][5] is True
    assert rows[1, 0][6:10] == (3, 2, len("hello there") + 2 + len("my key is [redacted-sk] ok"), 1)
    assert rows[3, 0][3] == "" and rows[3, 0][6] == 0 and rows[3, 0][-1] is None
    # the same as from all files at once
    whole = f"{out}-whole"
    transcripts.run(spark, str(source), whole, f"{mark}-whole", 4, 500)
    assert standing(spark, out) == standing(spark, whole)


def test_turns_that_come_again_replace_earlier_ones(spark, places):
    source, out, mark = places
    put(spark, [(1, 0, "user", "first words"), (1, 0, "user", "first words"), (1, 1, "user", "zz"), (1, 1, "user", "aa")], source)
    transcripts.run(spark, str(source), out, mark, 2)
    assert [(r[1], r[3]) for r in standing(spark, out)] == [(0, "first words"), (1, "zz")]
    put(spark, [(1, 0, "user", "better words"), (1, 1, "user", " \n")], source)
    transcripts.run(spark, str(source), out, mark, 2)
    assert [(r[1], r[3]) for r in standing(spark, out)] == [(0, "better words"), (1, "")]


def test_a_batch_that_was_cut_short_is_done_again(spark, places, monkeypatch):
    source, out, mark = places
    put(spark, [(k, 0, "user", f"words {k}") for k in range(9)], source)
    transcripts.run(spark, str(source), out, mark, 4)
    put(spark, [(k, 1, "user", f"more {k}") for k in range(9)], source)
    real = transcripts.contexts
    monkeypatch.setattr(transcripts, "contexts", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        transcripts.run(spark, str(source), out, mark, 4)
    monkeypatch.setattr(transcripts, "contexts", real)
    again = transcripts.run(spark, str(source), out, mark, 4)
    assert again["read"] == 9
    assert [r[3] for r in standing(spark, out)] == [f"{w} {k}" for k in range(9) for w in ("words", "more")]
    whole = f"{out}-whole"
    transcripts.run(spark, str(source), whole, f"{mark}-whole", 4)
    assert standing(spark, out) == standing(spark, whole)


def test_only_touched_buckets_are_written(spark, places):
    source, out, mark = places
    put(spark, [(k, 0, "user", f"words {k}") for k in range(40)], source)
    transcripts.run(spark, str(source), out, mark, 16)
    before = files(f"{out}/contexts")
    put(spark, [(5, 1, "user", "more")], source)
    transcripts.run(spark, str(source), out, mark, 16)
    after = files(f"{out}/contexts")
    assert len({path.parent for path, _ in {*before.items()} ^ {*after.items()}}) == 1


def test_few_files_at_a_time_and_empty_or_single_files(spark, places, sf):
    source, out, mark = places
    put(spark, [], source)
    assert transcripts.run(spark, str(source), out, mark)["turns"] == 0
    for k in range(3):
        put(spark, [(1, k, "user", f"turn {k}")], source)
    assert transcripts.run(spark, str(source), out, mark, most_files=1)["batches"] >= 3
    assert len(standing(spark, out)) == 3
    single = transcripts.run(spark, f"{sf}/conversations.parquet", f"{out}-2", f"{mark}-2")
    assert single["read"] == spark.read.parquet(f"{sf}/conversations.parquet").count()


DOCS, LABELS = "doc_id long, text string, lang string, source string, more int", "doc_id long, quality int, toxic int"


def tables(spark, tmp_path, docs, labels):
    put(spark, docs, tmp_path / "docs", DOCS)
    put(spark, labels, tmp_path / "labels", LABELS)
    return str(tmp_path / "docs"), str(tmp_path / "labels"), str(tmp_path / "out")


def fold(text):
    return hashlib.sha256(re.sub(r"[\W_]+", "", text.lower()).encode()).hexdigest()


def test_memories_beside_a_plain_version(spark, tmp_path):
    texts = ["One thing.", "one, THING!", "two things\nand more", None, "  ", "bad words", "Bad Words", "key sk-abcdefghijklmnop1234", "!!!"]
    docs = [(k, texts[k % 9], ["en", "fr", None][k % 3], f"s{k % 2}", k) for k in range(27)] + [(None, "no id", "en", "s0", 0)]
    labels = [(0, 1, 0), (0, 0, 0), (5, 0, 1), (2, 0, 0), (None, 1, 1), (400, 1, 1)]
    paths = tables(spark, tmp_path, docs, labels)
    counts = knowledge.run(spark, *paths, most_evidence=5)
    groups = {}
    for k, text, lang, source, _ in docs:
        text = (text or "").strip().replace("sk-abcdefghijklmnop1234", "[redacted-sk]")
        if k is not None and text:
            groups.setdefault(fold(text), []).append((k, text, lang, source))
    toxic = {fold("bad words")}
    want = sorted(
        (min(g)[0], d, min(g)[1], min(len(g), 5), len({s for *_, s in g}), 0.9 if min(g)[0] == 0 else 0.3 if min(g)[0] == 2 else 0.5)
        for d, g in groups.items() if d not in toxic
    )
    got = knowledge.read(spark, paths[2])
    assert sorted((r.id, r.digest, r.content, r.evidence, r.sources, r.confidence) for r in got.where("part = 'memory'").collect()) == want
    assert [(r.digest, r.evidence) for r in got.where("part = 'tombstone'").collect()] == [(fold("bad words"), 6)]
    assert counts == {"read": 28, "said_something": 21, "memories": len(want), "tombstones": 1}
    cards = {r.domain: (r.memories, r.evidence) for r in spark.read.parquet(f"{paths[2]}/cards").collect()}
    assert sum(n for n, _ in cards.values()) == len(want) and sum(e for _, e in cards.values()) == sum(w[3] for w in want)


def test_a_second_run_gives_the_same(spark, tmp_path):
    docs = [(k, f"text {k % 5}", "en", "s", 0) for k in range(20)] + [(3, "text 3", "aa", "t", 0), (3, "Text 3!", "en", "s", 0)]
    paths = tables(spark, tmp_path, docs, [(4, 1, 1)])
    seen = []
    for _ in range(2):
        knowledge.run(spark, *paths)
        seen.append(sorted(map(repr, knowledge.read(spark, paths[2]).collect())))
    assert seen[0] == seen[1]
    three = [r for r in knowledge.read(spark, paths[2]).collect() if r.id == 3]
    assert [(r.content, r.evidence, r.domain) for r in three] == [("Text 3!", 6, "aa")]


def test_empty_tables(spark, tmp_path):
    paths = tables(spark, tmp_path, [], [])
    assert knowledge.run(spark, *paths)["memories"] == 0
    assert knowledge.read(spark, paths[2]).count() == 0


def test_command_line(tmp_path, sf):
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"most_evidence": 2}))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.knowledge", f"{sf}/documents.parquet", f"{sf}/labels.parquet", str(tmp_path / "out"), "--config", str(config)],
        cwd=ROOT, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr
    assert "'memories':" in done.stderr and (tmp_path / "out" / "memories").is_dir()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, sf, duck):
    frame = registry.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    result = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert got == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())


def test_settings_are_restored(spark, sf):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    registry.job1_transcripts(spark, sf)
    assert {k: spark.conf.get(k) for k in before} == before
