"""Packing by lexical retrieval: a seed's neighbours by BM25 fill its window.

A shard of documents has an inverted index with BM25 weights, whose terms are the vocabulary's
ids. The next document that isn't placed yet is the seed of a window; the index ranks those that are still
unused. The best that fit whole go in, one after another; then the best one left is cut, so that the window is
full, and what is left of it is the next seed. So windows have no padding; what remains at a task's end
fills sequences of powers of two, which have none either.

Scale: texts are encoded where they lie. Of a long document, windows that it fills alone are done then;
what is left of it, and each shorter one, is a unit with its ids (16 bits each), which is checkpointed. How many
documents have a term is counted over all whole documents; as a vector of the vocabulary's length it is
broadcast. Units are dealt by ranges of their two most telling terms (repeated ones that the vocabulary
merges late), and by hash among equals, so that what is alike is together and no key is hot. A task reads its range in
order, in shards of ``SHARD`` units, and carries an open window on to the next shard.

BM25: a term's weight is log((N - n + 0.5) / (n + 0.5)) for n of N documents, nothing if that is negative; a seed's terms
count once each; lengths are units'.

Defined cases: a null text counts as empty and is the end token alone; documents of any length are cut
into as many pieces as needed; of equal scores the first in the shard's order wins; repeated rows are packed once each; where
no unused document shares a weighty term, the next one in order fills the window; an empty table
gives an empty result; columns besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bpe import read_vocabulary
from anamnesis.llm.chunks import ByteLevel, in_words
from anamnesis.llm.common import durable, map_rows, pick, settle

CAPACITY = 2048
END_ID = 1
#: Units in one inverted index, and units that a task reads, about.
SHARD = 2048
TASK = 4 * SHARD
K1, B = 1.2, 0.75

_FULL, _UNIT, _STATISTICS = 0, 1, 2


class Encoder:
    def __init__(self, text: str):
        self.byte_level = ByteLevel(text)
        self.size = self.byte_level.size
        if self.size > 1 << 16:
            raise ValueError("ids don't fit 16 bits")

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; of a block of texts each part is encoded once."""
        for words, others, numbers in in_words(texts):
            coded, ends = self.byte_level.flat_words(words)
            more, more_ends = self.byte_level.flat([p for p in others if p])
            flat = np.concatenate([coded, more]).astype(np.uint16)
            count = np.zeros(len(words) + len(others), np.int64)
            count[: len(words)] = np.diff(ends, prepend=0)
            count[len(words) :][[*map(bool, others)]] = np.diff(more_ends, prepend=0)
            first = np.cumsum(count) - count
            which = np.concatenate(numbers)
            sizes = count[which]
            ends = np.cumsum(sizes)
            ids = flat[np.repeat(first[which] - ends + sizes, sizes) + np.arange(ends[-1])]
            last = ends[np.cumsum([*map(len, numbers)]) - 1]
            yield from np.split(ids, last[:-1])


_built: dict[int, Encoder] = {}


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and how often each comes; a stable sort of 16 bits is numpy's fastest."""
    ids = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[first], np.diff(first, append=len(ids))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows, units with their ids and most telling terms, and statistics: of each task one row with how many
    documents have each term, then the numbers of documents, of units, and of units' tokens."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def rows(batches):
        text = vocabulary.value
        key = hash(text)
        if key not in _built:
            _built[key] = Encoder(text)
        encoder = _built[key]
        counts = np.zeros(encoder.size + 3, np.int64)
        # a rule to deal by alone: the vocabulary merges what is frequent first
        lateness = np.log1p(np.arange(encoder.size, dtype=np.float32))
        for batch in batches:
            for key, ids in zip(batch["id"], encoder.encode_all(batch["text"])):
                ids = np.append(ids, np.uint16(END_ID))
                terms, times = distinct(ids)
                counts[terms] += 1
                telling = times / (times + K1) * lateness[terms]
                first = second = int(terms[k := telling.argmax()])
                if len(terms) > 1:
                    telling[k] = -1
                    second = int(terms[telling.argmax()])
                whole = len(ids) - len(ids) % capacity
                for at in range(0, whole, capacity):
                    yield _FULL, key, at, capacity, checksum(ids[at : at + capacity]), len(ids), first, second, None
                if whole < len(ids):
                    yield _UNIT, key, whole, len(ids) - whole, None, len(ids), first, second, ids[whole:].tobytes()
                    counts[-2:] += 1, len(ids) - whole
                counts[-3] += 1
        if counts[-3]:
            yield _STATISTICS, None, None, None, None, None, None, None, counts.tobytes()

    names = ["kind", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "first", "second", "ids"]
    types = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary()]
    return map_rows(
        pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long")),
        "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, first int, second int, ids binary",
        pa.schema(list(zip(names, types))),
        rows,
        lambda row: 120 + len(row[8] or b""),
        as_arrow=("text",),
    )


def statistics(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' vectors. The driver gets one number for each term of the vocabulary."""

    def split(batches):
        total = None
        for batch in batches:
            for raw in batch["ids"]:
                counts = np.frombuffer(raw, np.int64)
                total = counts if total is None else total + counts
        if total is not None:
            yield from zip(range(len(total)), total.tolist())

    parts = map_rows(rows.where(F.col("kind") == _STATISTICS).select("ids"), "term long, n long", pa.schema([("term", pa.int64()), ("n", pa.int64())]), split)
    found = parts.groupBy("term").agg(F.sum("n").alias("n")).toPandas().sort_values("term")
    return found["n"].to_numpy(np.int64)


@dataclass
class Unit:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


class Index:
    """BM25 weights of a shard's units by term; those of placed units go when half of them are placed."""

    def __init__(self, units: list[Unit], idf: np.ndarray, mean: float):
        sizes = np.array([len(u.ids) for u in units])
        keys = np.concatenate([u.ids for u in units]).astype(np.int64) * len(units) + np.repeat(np.arange(len(units)), sizes)
        keys, times = np.unique(keys, return_counts=True)
        terms, self.unit = np.divmod(keys, len(units))
        weight = idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[self.unit] / mean))
        heavy = weight > 0
        self.unit, self.weight = self.unit[heavy], weight[heavy]
        self.first = np.searchsorted(terms[heavy], np.arange(len(idf) + 1))
        self.free = np.ones(len(units), bool)
        self.kept = self.left = len(units)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Of each unit; -1 for those that are placed."""
        starts, ends = self.first[terms], self.first[terms + 1]
        some = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b > a]
        if some:
            units = np.concatenate([self.unit[s] for s in some])
            total = np.bincount(units, np.concatenate([self.weight[s] for s in some]), len(self.free))
        else:
            total = np.zeros(len(self.free))
        total[~self.free] = -1
        return total

    def place(self, k: int) -> None:
        self.free[k] = False
        self.left -= 1
        if 2 * self.left < self.kept and self.left:
            kept = self.free[self.unit]
            self.first = np.concatenate([[0], np.cumsum(kept)])[self.first]
            self.unit, self.weight, self.kept = self.unit[kept], self.weight[kept], self.left


@dataclass
class Packer:
    """Windows of one task; ``add`` takes a shard, ``close`` gives what is left."""

    idf: np.ndarray
    mean: float
    capacity: int = CAPACITY
    window: list[tuple[Unit, int, int]] = field(default_factory=list)
    gap: int = 0
    terms: np.ndarray | None = None
    number: int = 0

    def _put(self, unit: Unit, a: int, b: int) -> Iterator[tuple]:
        self.window.append((unit, a, b))
        self.gap -= b - a
        if not self.gap:
            yield from self._emit(self.window)
            self.window = []

    def _emit(self, parts: list[tuple[Unit, int, int]]) -> Iterator[tuple]:
        at = 0
        for unit, a, b in parts:
            yield unit.doc_id, unit.start + a, b - a, checksum(unit.ids[a:b]), unit.doc_tokens, self.number, at
            at += b - a
        self.number += 1

    def _seed(self, unit: Unit, a: int) -> Iterator[tuple]:
        self.gap = self.capacity
        self.terms = distinct(unit.ids)[0].astype(np.int64)
        yield from self._put(unit, a, len(unit.ids))

    def add(self, units: list[Unit]) -> Iterator[tuple]:
        index = Index(units, self.idf, self.mean)
        sizes = np.array([len(u.ids) for u in units])
        following = 0
        while True:
            while following < len(units) and not index.free[following]:
                following += 1
            if following == len(units):
                return
            if not self.window:
                index.place(following)
                yield from self._seed(units[following], 0)
                continue
            scores = index.scores(self.terms)
            while self.window:
                fitting = np.where(sizes <= self.gap, scores, -1)
                k = int(fitting.argmax())
                if fitting[k] <= 0:
                    k = int(scores.argmax())  # the first in order, if nothing has a score
                    if scores[k] < 0:
                        break
                index.place(k)
                scores[k] = -1
                unit, end = units[k], min(self.gap, len(units[k].ids))
                yield from self._put(unit, 0, end)
                if end < len(unit.ids):
                    yield from self._seed(unit, end)
                    break

    def close(self) -> Iterator[tuple]:
        """The open window in sequences of powers of two, the longest first."""
        rest = self.window[::-1]
        left = self.capacity - self.gap if rest else 0
        while left:
            size = room = 1 << (left.bit_length() - 1)
            parts = []
            while room:
                unit, a, b = rest.pop()
                end = min(b, a + room)
                parts.append((unit, a, end))
                room -= end - a
                if end < b:
                    rest.append((unit, end, b))
            yield from self._emit(parts)
            left -= size
        self.window = []


def pack_by_retrieval(
    docs: DataFrame, path: str, capacity: int = CAPACITY, shard: int = SHARD, task: int = TASK, **names: str
) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    settle(docs.sparkSession)
    rows = durable(encoded(docs, path, capacity, **names))
    counts = statistics(rows)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    numbered = {"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")}
    full = rows.where(F.col("kind") == _FULL).withColumns(numbered).select(*columns)
    if not len(counts):
        return full
    n, units, tokens = counts[-3:].tolist()
    mean = tokens / max(units, 1)
    held = counts[:-3]
    known = docs.sparkSession.sparkContext.broadcast(np.maximum(np.log((n - held + 0.5) / (held + 0.5)), 0))

    def packed(batches):
        packer = Packer(known.value, mean, capacity)
        high = TaskContext.get().partitionId() << 32
        waiting: list[Unit] = []

        def out(pieces):
            for *piece, number, at in pieces:
                yield (*piece, (high + number) * 2, at)

        for batch in batches:
            for key, start, total, ids in zip(batch["doc_id"], batch["start"], batch["doc_tokens"], batch["ids"]):
                waiting.append(Unit(key, start, total, np.frombuffer(ids, np.uint16)))
                if len(waiting) == shard:
                    yield from out(packer.add(waiting))
                    waiting = []
        if waiting:
            yield from out(packer.add(waiting))
        yield from out(packer.close())

    dealt = rows.where(F.col("kind") == _UNIT).select("doc_id", "start", "doc_tokens", "ids", "first", "second")
    order = ["first", "second", F.xxhash64("ids"), F.xxhash64("doc_id", "start")]
    dealt = dealt.repartitionByRange(max(1, -(-units // task)), *order).sortWithinPartitions(*order)
    fields = [(c, pa.int64()) for c in columns]
    return full.unionByName(map_rows(dealt, ", ".join(f"{c} long" for c in columns), pa.schema(fields), packed))
