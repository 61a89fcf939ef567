"""Packing, sharding, near duplicates, neighbours and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from anamnesis.llm import components as components_module
from anamnesis.llm import hnsw, jaccard, packing, sharding
from anamnesis.llm.components import components
from anamnesis.llm.q_sharding import op9_lpt_shards

PATH = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def lawful(rows, capacity):
    """Whether sequences are gapless and hold no more than they can."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("last", [False, True])
def test_sum_of_squares_rule(last):
    sizes = np.array([5, 4, 3, 3, 2, 2, 1])
    sequence, offset, gaps = packing.sum_of_squares(sizes, 10, last)
    assert np.bincount(sequence, sizes).tolist() == [10 - g for g in gaps]
    # a plain form of the same rule
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 50, 300)
    sequence, _, gaps = packing.sum_of_squares(sizes, 50, last)
    state = []
    for i in np.argsort(-sizes, kind="stable"):
        s = sizes[i]

        def total(k):
            after = [g - s if j == k else g for j, g in enumerate(state)] + ([50 - s] if k is None else [])
            return sum(v * v for g, v in Counter(after).items() if g), k is None, 0 if k is None else state[k]

        room = [k for k, g in enumerate(state) if g >= s]
        best = min(room if last and room else [*room, None], key=total)
        if best is None:
            state.append(50 - s)
        else:
            state[best] -= s
    assert sorted(state) == sorted(gaps.tolist())


def test_packing_laws(spark):
    texts = [None, "", "one two", "one two", "word " * 5000, *("w " * n for n in range(1, 400, 7))]
    rows = docs_of(spark, texts).withColumns({"x": F.lit(1), "y": F.lit("z")}).toDF("doc_id", "text", "TEXT", "offset")
    out = packing.pack_documents(rows, PATH, 256).collect()
    lawful(out, 256)
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert {*pieces} == {*range(len(texts))}
    for parts in pieces.values():
        parts.sort()
        assert [p for p, _, _ in parts] == [*range(len(parts))] and all(n == 256 for _, _, n in parts[:-1])
        assert [s for _, s, _ in parts] == [256 * k for k in range(len(parts))]
    assert pieces[0] == pieces[1] == [(0, 0, 1)]
    assert packing.pack_documents(docs_of(spark, []), PATH).count() == 0


def test_packing_in_groups_is_tight(spark):
    r = random.Random(4)
    rows = [(i, r.randint(1, 1200)) for i in range(3000)] + [(9000, 2048), (9000, 2048)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").repartition(3)
    pieces = packing.durable(pieces)
    out = packing.pack(pieces, group=400).collect()
    used = lawful(out, 2048)
    assert len(out) == len(rows)
    assert used <= 1.01 * -(-sum(n for _, n in rows) // 2048) + 1


def plain_longest_first(sizes, shards):
    """Item by item, largest first, to the least loaded shard."""
    loads = [0] * shards
    counts = {}
    for s in sorted(sizes, reverse=True):
        k = loads.index(min(loads))
        loads[k] += s
        counts.setdefault(s, [0] * shards)[k] += 1
    return counts, loads


@pytest.mark.parametrize("seed", range(6))
def test_longest_first_equals_a_plain_schedule(seed):
    r = random.Random(seed)
    sizes = [r.choice((17, 20, r.randint(16, 60), r.randint(16, 5000))) for _ in range(r.choice((0, 3, 400, 3000)))] + [10**6] * (seed % 2)
    counts, _ = plain_longest_first(sizes, 7)
    assert dict(sharding.longest_first(Counter(sizes), 7)) == counts


def test_all_groups_are_scheduled_by_size(spark, monkeypatch):
    """Loads are those of the plain schedule over all groups; small cells deal a common size out."""
    monkeypatch.setattr(sharding, "CELL", 7)
    monkeypatch.setattr(sharding, "HOT", 5)
    r = random.Random(8)
    texts = ["hot"] * 400 + ["x" * r.choice((3, 3, r.randint(1, 90))) + str(i % 500) for i in range(900)] + ["long " * 4000, None, ""]
    rows = docs_of(spark, texts).withColumns({"x": F.lit(1), "y": F.lit(2)}).toDF("doc_id", "text", "TEXT", "shard").repartition(5)
    out = sharding.shard_by_bytes(rows, 6).collect()
    check_shards(out, dict(enumerate(texts)), 6)
    groups = Counter()
    for t in texts:
        groups[t] += len((t or "").encode()) + 16
    loads = Counter()
    for x in out:
        loads[x.shard] += x.size
    assert [loads[k] for k in range(6)] == plain_longest_first(groups.values(), 6)[1]


def test_sharding_laws(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_lpt_shards(spark, sf).collect()
    check_shards(rows, texts, 40)
    hot = ["same"] * 700 + [f"text {i} " * (i % 50 + 1) for i in range(900)] + [None, None, "", ""]
    out = sharding.shard_by_bytes(docs_of(spark, hot), 5).collect()
    check_shards(out, dict(enumerate(hot)), 5)
    assert len({r.shard for r in out if hot[r.doc_id] is None}) == 1
    repeated = sharding.shard_by_bytes(docs_of(spark, ["a", "a", "b"], [1, 1, None]), 2).collect()
    assert len(repeated) == 3 and len({(r.shard, r.slot) for r in repeated}) == 3
    assert sharding.shard_by_bytes(docs_of(spark, []), 5).count() == 0


def check_shards(rows, texts, shards):
    assert len(rows) == len(texts)
    groups, loads, slots, largest = {}, Counter(), {}, Counter()
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 16
        groups.setdefault(text, set()).add(r.shard)
        loads[r.shard] += r.size
        largest[text] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    mean = sum(loads.values()) / shards
    assert max(loads.values()) <= max(mean * 1.02 + 16, max(largest.values()) * 1.02)


def brute(texts, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"\w+", t.lower()) if t is not None else []
        runs = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else ({("", t)} if t is not None else set())
        sets[i] = runs
    links, root = Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    copies = {i: min(j for j in ids if j == i or (sets[j] and sets[j] == sets[i])) for i in ids}
    return {i: (copies[i], find(i), links[i]) for i in ids}


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"edit{r.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block,broadcast", [(1024, 200_000), (8, 200_000), (1024, 0)])
def test_jaccard_equals_brute_force(spark, monkeypatch, block, broadcast):
    """Small blocks make every group of copies a large one."""
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", broadcast)
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    texts = [None, None, "", "", "!!!", "!!!", "two words", "Two, WORDS", "one"]
    for size, copies, edits in ((120, 40, 4), (60, 10, 3), (300, 6, 12), (30, 5, 1)):
        texts += near_copies(r, " ".join(word() for _ in range(size)), copies, edits)
    texts += [" ".join(word() for _ in range(80)) for _ in range(30)]
    texts.append(" ".join(word() for _ in range(20_000)))
    texts += [texts[-1], texts[-1] + " tail"]
    r.shuffle(texts)
    out = jaccard.jaccard_classes(docs_of(spark, texts), block=block).collect()
    assert {x.doc_id: (x.copy_id, x.class_id, x.n_links) for x in out} == brute(dict(enumerate(texts)))


def test_jaccard_on_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h"
    rows = docs_of(spark, [text, text, text, "other words that stand alone here"], [4, 4, 7, 1])
    rows = rows.withColumn("x", F.lit(1)).toDF("doc_id", "text", "TEXT")
    out = sorted((r.doc_id, r.copy_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(rows).collect())
    assert out == [(1, 1, 1, 0), (4, 4, 4, 2), (4, 4, 4, 2), (7, 4, 4, 2)]
    assert jaccard.jaccard_classes(docs_of(spark, [])).count() == 0


def test_shortening_ends_at_the_target():
    k = jaccard.least_depth(0.8, jaccard.TREES, jaccard.TARGET_RECALL, jaccard.LEVELS)
    chance = lambda d: 1 - (1 - 0.8**d) ** jaccard.TREES
    assert chance(k) >= jaccard.TARGET_RECALL > chance(k + 1) and 1 < k < jaccard.LEVELS
    assert jaccard.least_depth(0.5, 4, 0.99, 8) < k < jaccard.least_depth(0.99, 64, 0.9, 8)


def test_nodes_are_those_of_a_trie():
    rng = np.random.default_rng(6)
    tails = rng.integers(0, 3, (60, 3)).astype(np.uint8)
    got = [(d, tuple(sorted(x.tolist()))) for d, x in jaccard.nodes(tails)]
    want = set()
    for d in range(4):
        by = {}
        for i, t in enumerate(tails):
            by.setdefault(tuple(t[:d]), []).append(i)
        want |= {(d, tuple(x)) for x in by.values() if len(x) > 1}
    assert {*got} == want and len(got) == len(want) and [d for d, _ in got] == sorted((d for d, _ in got), reverse=True)


@pytest.mark.parametrize("seed", range(5))
def test_subtrees_are_connected_as_by_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (6, 64)).astype(np.uint8)
    signatures = base[rng.integers(0, 6, 80)].copy()
    noise = rng.random(signatures.shape) < rng.uniform(0, 0.5, (80, 1))
    signatures[noise] = rng.integers(0, 256, int(noise.sum()))
    root = [*range(80)]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(80):
        for j in range(i):
            if (signatures[i] == signatures[j]).sum() >= 0.62 * 64:
                root[find(i)] = find(j)
    want = {frozenset(i for i in range(80) if find(i) == r) for r in map(find, range(80))}
    root = [*range(80)]
    edges = [*jaccard.connect_similar([*range(80)], signatures, signatures[:, 4:6], 0.62)]
    for a, b in edges:
        assert find(a) != find(b)
        root[find(a)] = find(b)
    assert {frozenset(i for i in range(80) if find(i) == r) for r in map(find, range(80))} == want


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_components(spark, monkeypatch, hot):
    """No node is hot, some are, or all."""
    monkeypatch.setattr(components_module, "HOT", hot)
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def exact(ids, vectors, query, own, k):
    scores = (vectors.astype(np.float64) * query.astype(np.float64)).sum(axis=1)
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != own]
    return [(int(ids[j]), float(scores[j])) for j in order[:k]]


@pytest.mark.parametrize("shard,size", [(32_768, 96 << 20), (700, 96 << 20), (32_768, 64 << 10)])
def test_neighbours_recall(spark, monkeypatch, shard, size):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", shard)
    monkeypatch.setattr(hnsw, "SHARD_BYTES", size)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    vectors = (centres[rng.integers(0, 30, 2100)] + 0.5 * rng.normal(size=(2100, 24))) * rng.uniform(0.5, 2, (2100, 1))
    vectors = vectors.astype(np.float32)
    vectors[500:900] = vectors[500]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = {}
    for r in hnsw.search(vectors_of(spark, rows).repartition(3), F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.arange(2100)
    assert {*found} == {*range(0, 2100, 20)}
    hit = same = 0
    for q, got in found.items():
        want = exact(ids, vectors, vectors[q], q, 20)
        hit += len({i for i, _ in got} & {i for i, _ in want})
        same += sum(w == g for w, g in zip(want, got))
        assert len(got) == 20 and all(s == pytest.approx(float((vectors[i].astype(float) * vectors[q].astype(float)).sum()), abs=1e-12) for i, s in got)
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
    assert hit >= 0.95 * 20 * len(found)


def test_neighbours_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, [2.0, 0.0]), (40, [2.0, 0.0])]
    frame = vectors_of(spark, rows).withColumn("E", F.lit(1)).toDF("vec_id", "embedding", "EMBEDDING")
    got = [tuple(r) for r in hnsw.search(frame, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 40, 2.0), (0, 2, 1, 1.0), (0, 3, 8, 0.5), (40, 1, 0, 2.0), (40, 2, 1, 2.0), (40, 3, 8, 1.0)]
    assert hnsw.search(vectors_of(spark, []), F.col("id") % 20 == 0).count() == 0


def test_neighbours_are_scored_in_double_precision(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0 + 1e-12, 1.0]), (2, [1.0, 1.0 + 3e-12]), (3, [1e300, 1.0]), (20, [0.1, 0.7]), (40, [1e-300, 1e-300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = hnsw.search(frame, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    want = []
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted(((-(x[0] * v[0] + x[1] * v[1]), i) for i, v in rows if i != q))
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert [tuple(r) for r in out] == want


def test_shards_grow_with_the_table():
    assert [hnsw.shards_for(n, 64, 6) for n in (0, 500, 10_256, 51_282, 600_000)] == [1, 1, 1, 2, 6]
    assert hnsw.shards_for(10**9, 64, 6) * hnsw.SHARD_BYTES >= 10**9 * (8 * 64 + 8 * hnsw.LINKS) and hnsw.shards_for(10**9, 64, 6) < 10**9 / 100_000


def test_neighbours_beside_repeated_ids(spark):
    hot = [1.0, 2.0]
    rows = [(0, hot)] * 30 + [(1, hot)] * 25 + [(i, hot) for i in range(2, 30)] + [(40, [1.0, 1.0 + i / 64]) for i in range(50)] + [(41, [2.0, 1.0])]
    got = {}
    for r in hnsw.search(vectors_of(spark, rows).repartition(3), F.col("id").isin(0, 41), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(i, 5.0) for i in range(1, 21)], 41: [(i, 4.0) for i in range(20)]}


def test_neighbours_beside_an_id_with_many_vectors():
    vectors = np.array([[1.0, 1.0 + i / 1000] for i in range(300)] + [[0.5, i / 1000] for i in range(30)], np.float32)
    ids = np.array([7] * 300 + [*range(100, 130)])
    shard = hnsw.Shard(2, **hnsw.build_shard(ids, vectors))
    want = [7, *range(129, 110, -1)]
    assert shard.graph and shard.nearest(-1, vectors[0], 20)[0].tolist() == want
    assert shard.nearest(7, vectors[0], 20)[0].tolist() == [*range(129, 109, -1)]


def test_searches_widen_until_recall_suffices(monkeypatch):
    vectors = np.random.default_rng(8).normal(size=(3000, 48))
    monkeypatch.setattr(hnsw, "EF_SEARCH", 20)
    made = hnsw.build_shard(np.arange(3000), vectors)
    shard = hnsw.Shard(48, **made)
    assert 20 < shard.width < 3000
    asked = range(0, 3000, 30)
    scores = vectors[[*asked]] @ vectors.T
    met = 0
    for row, i in zip(scores, asked):
        row[i] = -np.inf
        met += len({*np.argsort(-row)[:20].tolist()} & {*shard.nearest(i, vectors[i], 20)[0].tolist()})
    assert met >= 0.95 * 20 * len(asked)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2))
    more = more.unionByName(spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "...", "en", "s", 3)], docs.schema))
    docs = docs.unionByName(more)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    kept = docs
    sizes = []
    for name, stage in P.STAGES[:3]:
        before, kept = kept, P.STAGES and stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        sizes.append(kept.count())
    assert sizes[0] == docs.count() - 2  # neither a text nor a letter
    want = brute({i: t for i, t in texts.items() if i not in (900_001, 900_002)})
    heads = {c for _, c, _ in want.values()}
    named = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(named) == sorted(heads)
    packed = P.packing_stage(spark, kept, sf).collect()
    lawful(packed, 2048)
    assert {r.doc_id for r in packed if r.doc_id is not None} == heads
    assert P.run(spark, sf).count() > 0


def test_pipeline_on_clashing_columns_and_empty_tables(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    names = [*docs.columns, "_hash", "TEXT", "_c0", "_head"]
    rows = docs.withColumns({"p": F.lit("keep"), "q": F.lit("too"), "r": F.lit(7), "s": F.lit(8)}).toDF(*names)
    for name, stage in P.STAGES[:3]:
        rows = stage(spark, rows, sf)
        assert rows.columns == names, name
        kept = rows.toDF(*(f"x{i}" for i in range(len(names)))).select("x5", "x6", "x7", "x8").distinct().collect()
        assert [tuple(r) for r in kept] == [("keep", "too", 7, 8)]
    assert P.packing_stage(spark, rows, sf).count() > 0
    empty = docs.limit(0)
    assert [stage(spark, empty, sf).count() for _, stage in P.STAGES] == [0] * 4
