"""Packing by retrieval: its laws, its scores and its rule beside plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anamnesis.llm import chunks
from anamnesis.llm import retrieval_packing as packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check_laws(pieces, texts, capacity):
    """Every id once, sequences gapless and without padding; returns sequences as lists of documents."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = ids_of(texts[p.doc_id])
        assert p.doc_tokens == len(ids) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        parts[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length, p.doc_id))
    for key, text in enumerate(texts):
        at = 0
        for start, length in sorted(parts[key]):
            assert start == at
            at += length
        assert at == len(ids_of(text))
    for mine in sequences.values():
        at = 0
        for offset, length, _ in sorted(mine):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    return [[k for _, _, k in sorted(mine)] for mine in sequences.values()]


@pytest.mark.parametrize("shard, task", [(2048, 8192), (7, 14), (1, 1)])
def test_laws(spark, shard, task):
    texts = [None, "", "one two", "one two", "<|endoftext|> a  b \n c", "語" * 300, "word " * 3000, *(f"topic{n % 3} " * (5 * n) for n in range(40))]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = rows.withColumns({"x": F.lit(1), "y": F.lit(2)}).toDF("doc_id", "text", "TEXT", "offset")
    out = packing.pack_by_retrieval(rows, PATH, 256, shard, task).collect()
    check_laws(out, texts, 256)


def test_lengths_at_the_border_and_empty_tables(spark):
    texts = ["a" + " a" * (n - 2) for n in (255, 256, 257, 512, 513)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    check_laws(packing.pack_by_retrieval(rows, PATH, 256).collect(), texts, 256)
    assert packing.pack_by_retrieval(rows.limit(0), PATH).count() == 0
    whole = rows.where("doc_id = 1")
    assert [tuple(r)[1:3] for r in packing.pack_by_retrieval(whole, PATH, 256).collect()] == [(0, 256)]


def test_what_is_alike_shares_windows(spark):
    words = [[f"{a}{b}" for b in ("ra", "ti", "mo", "lu", "ke", "so", "ni", "va")] for a in ("Zor", "Quim", "Blax", "Fen", "Gru", "Wex")]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words[n % 6], 60)) for n in range(240)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    windows = check_laws(packing.pack_by_retrieval(rows, PATH, 512).collect(), texts, 512)
    alike = [max(Counter(k % 6 for k in w).values()) / len(w) for w in windows if len(w) > 2]
    assert np.mean(alike) > 0.9


def plain_scores(units, query, free, held, n, mean):
    out = []
    for k, unit in enumerate(units):
        count, score = Counter(unit), 0.0
        for t in {*query}:
            if count[t]:
                idf = max(math.log((n - held[t] + 0.5) / (held[t] + 0.5)), 0)
                score += idf * count[t] * 2.2 / (count[t] + 1.2 * (0.25 + 0.75 * len(unit) / mean))
        out.append(score if free[k] else -1)
    return out


def test_windows_follow_plain_bm25():
    """The same pieces as from a plain version of rule and scores, over two shards with an open window."""
    rng = np.random.default_rng(5)
    size, capacity = 60, 64
    units = [(rng.zipf(1.5, rng.integers(1, 60)) % size).tolist() for _ in range(90)]
    held, n = Counter(t for u in units for t in {*u}), len(units)
    mean = sum(map(len, units)) / n
    idf = np.array([max(math.log((n - held[t] + 0.5) / (held[t] + 0.5)), 0) for t in range(size)])
    packer = packing.Packer(idf, mean, capacity)
    made = [packing.Unit(k, 0, len(u), np.array(u, np.uint16)) for k, u in enumerate(units)]
    got = [(p[0], p[1], p[2], p[5]) for shard in (made[:50], made[50:]) for p in packer.add(shard)]
    got += [(p[0], p[1], p[2], p[5]) for p in packer.close()]
    want, number, gap, query = [], 0, 0, None
    for lo, hi in ((0, 50), (50, 90)):
        mine, free = units[lo:hi], [True] * (hi - lo)
        while any(free):
            if not gap:
                k = free.index(True)
                query, gap, start = mine[k], capacity, 0
            else:
                scores = plain_scores(mine, query, free, held, n, mean)
                fit = [k for k in range(hi - lo) if scores[k] > 1e-12 and len(mine[k]) <= gap]
                k = max(fit, key=lambda k: (round(scores[k], 9), -k)) if fit else max(range(hi - lo), key=lambda k: (round(scores[k], 9), -k))
                start = 0
            free[k] = False
            while start < len(mine[k]):
                if not gap:
                    number, gap, query = number + 1, capacity, mine[k]
                end = min(len(mine[k]), start + gap)
                want.append((lo + k, start, end - start, number))
                gap, start = gap - (end - start), end
            if not gap:
                number += 1
    whole = [w for w in want if w[3] < number] if gap else want
    assert got[: len(whole)] == whole
    assert sum(p[2] for p in got) == sum(map(len, units))


def test_index_without_placed_units_scores_the_same():
    rng = np.random.default_rng(6)
    units = [packing.Unit(k, 0, 20, rng.integers(0, 30, 20).astype(np.uint16)) for k in range(40)]
    index, whole = (packing.Index(units, np.ones(30), 20.0) for _ in range(2))
    for k in rng.permutation(40)[:35].tolist():
        index.place(k)
        whole.free[k] = False
        terms = np.arange(30)
        assert np.allclose(index.scores(terms), whole.scores(terms))
    assert len(index.unit) < len(whole.unit) / 2


def test_words_stay_in_arrow_and_ids_are_the_librarys(monkeypatch):
    """Python handles a text's first part and what has odd spaces, not each word, whatever blocks texts come in."""
    encoder = packing.Encoder(packing.read_vocabulary(PATH))
    plain = [" ".join(f"w{(k * n) % 997}x" for n in range(1, 400)) for k in range(1, 30)]
    ((words, others, numbers),) = packing.in_words(pa.array(plain))
    assert len(others) <= len(plain) and len(words) > 900 and [*map(len, numbers)] == [399] * len(plain)
    odd = [None, "", " ", "a", " a", "a ", "a  b", "a \n b", "a\x1c b", "a\x85 b c", "a　 b", "é è  ê", "語 言", "<|endoftext|> a", "x" * 25_000 + " y", "it's we'll\n\n  I've"]
    texts = [*odd, *plain, *odd]
    want = [ids_of(t)[:-1] for t in texts]
    for chars in (6_000_000, 3_000, 1):
        monkeypatch.setattr(chunks, "BLOCK_CHARS", chars)
        for rows in (pa.array(texts), pa.array(["cut", *texts], pa.large_string()).slice(1), pa.array(odd[:2])):
            assert [ids.tolist() for ids in encoder.encode_all(rows)] == want[: len(rows)]
