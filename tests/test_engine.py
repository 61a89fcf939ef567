"""The store as one object."""

from pyspark.sql import functions as F

from anamnesis import fixtures as X
from anamnesis.engine import MemoryEngine
from anamnesis.plans import index, recall
from anamnesis.plans.judge import DECISIONS, ReplayJudge
from anamnesis.sources import sinks


def test_a_stores_life(spark, tmp_path):
    now = F.lit("2024-07-01 00:00:00").cast("timestamp")
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", ReplayJudge({}), now)
    engine.remember(summary="tabs", content="prefers tabs over spaces", kind="preference")
    engine.remember(summary="deploys", content="deploys on fridays", keywords=["release"])
    engine.remember(summary="odd", content="of an unknown kind", kind="nonsense")
    assert [r.kind for r in engine.memories().orderBy("id").collect()] == ["preference", "fact", "lesson"]
    assert engine.recall("where are spaces used", 1, mode="fast", scope="all").first().id == 1
    first = {r.id for r in engine.recall("spaces", 2, mode="fast", conversation="c").collect()}
    second = {r.id for r in engine.recall("spaces", 2, mode="fast", conversation="c").collect()}
    assert len(first) == 2 and not first & second
    ranked = engine.recall("spaces", 2, mode="fast", conversation="d").collect()
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True) and all(r.channel is not None for r in ranked)
    assert engine.store.read("recall_log").count() == 4
    engine.clear("c")
    assert {r.id for r in engine.recall("spaces", 2, mode="fast", conversation="c").collect()} == first
    engine.forget([2])
    engine.remember(summary="deploys", content="Deploys, on Fridays!")
    assert {r.status: r.n for r in engine.counts().collect()} == {"active": 2, "archived": 1}
    assert engine.recall("fridays", 5, mode="excavate", scope="all").first().id == 2
    engine.pin([3])
    assert [r.id for r in engine.inject()[0].collect()] == [3] and [r.id for r in engine.list().collect()] == [3, 1]


def test_changes_write_only_their_rows(spark, sf, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/s")
    rows = X.memories(spark, sf)
    engine.store.commit({"memories": rows.withColumn("last_seen_at", F.col("last_seen").cast("timestamp"))})
    engine.reindex()
    n = rows.count()

    def written(table):
        folder = engine.store.manifest()["tables"][table][-1]
        return spark.read.parquet(f"{tmp_path}/s/{folder}").count()

    engine.pin([3, 4])
    assert written("memories") == 2 and engine.memories().where("id IN (3, 4) AND pinned = 1").count() == 2
    engine.forget([5])
    assert written("memories") == 1 and engine.memories().where("id = 5").first().status == "archived" and engine.store.read("tombstones").count() == 1
    decided = spark.createDataFrame([(0, "REFINE", 7, None, None, None, "zebras only", ["z"])], DECISIONS["merge"])
    engine.judge = ReplayJudge({"merge": decided})
    engine.remember(summary="z", content="zebras")
    assert written("memories") == 1 and written("sizes") == 1 and engine.memories().count() == n
    # the refined row's older entries in the index don't count any more
    engine.judge = ReplayJudge({})
    assert [r.id for r in engine.recall("zebras", 1, mode="fast", scope="all").collect()] == [7]
    row = rows.where("id = 7").first()
    old = next(w for w in reversed(row.content.split()) if len(w) > 3 and w.lower() not in f"{row.summary} {row.keywords}".lower())
    hits = index.open_index(*(engine.store.read(t) for t in ("postings", "sizes", "memories"))).hits(spark.createDataFrame([(old.lower(),)], "term string"))
    assert hits.where("id = 7").count() == 0
    for k in range(3):
        engine.say("c", f"question {k}", f"answer {k}")
    assert written("replies") == 1 and written("topics") == 1
    assert [(r.reply_id, r.query, r.answer) for r in engine.store.read("replies").orderBy("reply_id").collect()] == [(k + 1, f"question {k}", f"answer {k}") for k in range(3)]
    versions = engine.store.newest()
    engine.recall("zebras", 1, mode="fast", conversation="c")
    assert engine.store.newest() == versions and engine.store.read("recall_log").count() == 2


def test_merge_decisions_and_texts(spark, tmp_path):
    now = F.lit("2024-07-01 00:00:00").cast("timestamp")
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", ReplayJudge({}), now)
    engine.remember(summary="tabs", content="prefers tabs")
    decided = spark.createDataFrame([(0, "REFINE", 1, None, None, None, "prefers tabs of width four", ["w"]), (0, "REINFORCE", 77, None, None, None, None, None)], DECISIONS["merge"])
    engine.judge = ReplayJudge({"merge": decided})
    engine.remember(summary="tabs", content="width four")
    row = engine.memories().first()
    assert (row.content, row.evidence, row.keywords, row.summary) == ("prefers tabs of width four", 2, "w", "tabs")
    plain = MemoryEngine(spark, f"file://{tmp_path}/t", None, now)
    plain.ingest("one line to keep\nand more of it", "file")
    assert plain.memories().first().summary == "one line to keep"


def test_sinks(spark, tmp_path):
    rows = [("default", "a/b", "T", "text", [1, 2], "mature", "active", 3)]
    profiles = spark.createDataFrame(rows, "owner string, theme string, title string, content string, memory_ids array<long>, maturity string, status string, version long")
    page = sinks.chapter_pages(profiles).first().page
    assert page == "# T\n\n> theme a/b · v3 · 2 memories · mature\n\ntext\n"
    sinks.write_pages(sinks.chapter_pages(profiles), f"{tmp_path}/pages")
    assert (tmp_path / "pages" / "theme=a-b").is_dir()
    cards = spark.createDataFrame([("o", "x", 1, "c" * 60), ("o", "y", 5, "d" * 60), ("p", "x", 1, "short")], "owner string, domain string, members long, card string")
    out = sinks.store_card(cards).collect()
    assert len(out) == 1 and out[0].card.startswith("## y\nddd")


def test_conversations(spark, tmp_path):
    now = F.lit("2024-07-01 00:00:00").cast("timestamp")
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", None, now)
    for n in range(1, 6):
        engine.say("c", f"question {n}", f"answer {n}" if n != 4 else None)
    engine.say("d", "other talk")
    replies = engine.store.read("replies").orderBy("topic_id", "reply_id").collect()
    assert [(r.topic_id, r.reply_id, r.answer) for r in replies] == [(1, 1, "answer 1"), (1, 2, "answer 2"), (1, 3, "answer 3"), (1, 4, ""), (1, 5, "answer 5"), (2, 1, "")]
    text = engine.context("c")
    assert text.endswith("3. question 3\n4. question 4\n5. question 5\n\n逐轮纪要（新→旧）：\n2. 用户：question 2\n1. 用户：question 1") and engine.context("nobody") == ""


def test_audits_and_backfills(spark, tmp_path):
    now = F.lit("2024-07-01 00:00:00").cast("timestamp")
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", None, now)
    for n in range(1, 4):
        engine.remember(summary=f"s{n}", content=f"content {n}", kind="lesson", domain="dev ops")
    assert engine.backfill() == 3
    assert [(r.keywords, r.mini) for r in engine.memories().orderBy("id").collect()][0] == ("dev ops", "s1")
    verdicts = [(1, "rewrite", "better", "better text"), (2, "archive", None, None), (3, "ok", None, None)]
    engine.judge = ReplayJudge({"audit": spark.createDataFrame(verdicts, DECISIONS["audit"])})
    assert {r.id for r in engine.audit().collect()} == {1, 2} and engine.memories().where("summary = 'better'").count() == 0
    engine.audit(dry_run=False)
    rows = {r.id: r for r in engine.memories().collect()}
    assert rows[1].content == "better text" and rows[2].status == "archived" and rows[3].status == "active"
    assert engine.store.read("memory_log").count() == 2


def test_probe_and_profiles(spark, tmp_path):
    now = F.lit("2024-07-01 00:00:00").cast("timestamp")
    profiles = [(1, "default", "dev", "Dev", "", "x" * 300, None, "active"), (2, "default", "dev/git", "Git", "uses git", "c", 1, "active"), (3, "default", "old", "Old", "", "c", None, "archived")]
    frame = spark.createDataFrame(profiles, "id long, owner string, theme string, title string, abstract string, content string, parent_id long, status string")
    picks = spark.createDataFrame([(0, None, 2), (1, 1, None), (2, None, 1), (3, None, 3), (4, None, 77)], DECISIONS["pick"])
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", ReplayJudge({"pick": picks}), now)
    engine.store.commit({"profiles": frame.withColumn("updated_at", now)})
    engine.judge = ReplayJudge({})
    engine.remember(summary="one", content="text")
    engine.judge = ReplayJudge({"pick": picks})
    found = engine.recalled("anything")
    assert [r.id for r in found.memories.collect()] == [1] and [(r.id, r.shown, len(r.gist)) for r in found.profiles.collect()] == [(2, "Dev / Git", 8), (1, "Dev", 121)]
    assert sorted((r.what, r.id, r.summary) for r in engine.probe().collect()) == [("memory", 1, "one"), ("profile", 1, "Dev"), ("profile", 2, "Dev / Git")]


def test_the_index_finds_what_a_scan_finds(spark, sf, tmp_path):
    now = F.lit("2024-07-01 00:00:00").cast("timestamp")
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", None, now)
    rows = X.memories(spark, sf)
    engine.store.commit({"memories": rows.withColumn("last_seen_at", F.col("last_seen").cast("timestamp"))})
    store = engine.store
    opened = lambda: index.open_index(store.read("postings"), store.read("sizes"), store.read("memories"))
    assert opened() is None
    engine.reindex()
    engine.remember(summary="new", content="a wholly new text about zebras")
    engine.remember(summary="", content="b")
    assert opened().rows == rows.count() + 2
    texts = [r.text[:60] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    for query in [*texts, "zebras", "de", "b", "nothing-like-it", ""]:
        found = recall.fast_recall(engine.memories(), query, F.to_date(now), 8, index=opened())
        plain = recall.fast_recall(engine.memories(), query, F.to_date(now), 8)
        assert [(r.id, r.score) for r in found.collect()] == [(r.id, r.score) for r in plain.collect()], query
    hits = opened().hits(spark.createDataFrame([("zebras",), ("ras",), ("bras",), ("ze",)], "term string"))
    assert {(r.term, r.tf) for r in hits.where(F.col("id") == F.lit(rows.count() + 1)).collect()} == {("zebras", 1), ("ras", 1), ("bras", 1), ("ze", 1)}
    # many questions, with an index or without, are what one at a time gives
    questions = spark.createDataFrame([(i, q) for i, q in enumerate([*texts, "zebras zebras de", "aaaa", "nothing-like-it", None])], "question long, text string")
    by_index, made = (sorted(recall.recall_many(engine.memories(), questions, F.to_date(now), 8, index=i).collect()) for i in (opened(), None))
    assert [(r[0], r[1], r[2], round(r[3], 9)) for r in by_index] == [(r[0], r[1], r[2], round(r[3], 9)) for r in made]
    assert engine.recall("zebras", 1, mode="fast", scope="all").first().content.endswith("zebras")
