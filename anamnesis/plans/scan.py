"""Text matches of many questions at once, for a store that has no index: two passes, which leave little behind.

The first reads contents where they lie and keeps of each row the numbers of the asked terms that it holds and how often,
some bytes for each; the second scores rows against all questions and keeps the best of each task. So neither places nor
pairs of rows and questions are written or moved.

A term is met by a hash of its length's characters at each place, and then compared with what stands there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.deploy import durable
from anamnesis.plans.index import BLOCK_CHARS, FIELDS, size_of

#: Terms of questions, counted with each question, that a task holds; with more, postings are joined.
MOST_WANTED = 200_000
#: Scores that are computed at once, and those that wait to be ranked.
BLOCK_SCORES, WAITING = 4_000_000, 1_000_000
_BASE, _TABLE_BITS = 0x9E3779B97F4A7C15, 20
_MASK = (1 << 64) - 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Terms:
    """Terms by length, to be found in many texts at once."""

    def __init__(self, terms: list[str]):
        self.lengths = []
        for length in sorted({len(t) for t in terms}):
            which = np.array([i for i, t in enumerate(terms) if len(t) == length])
            codes = np.array([_codes(terms[i]) for i in which])
            power = np.array([pow(_BASE, i, 1 << 64) for i in range(length)], np.uint64)
            marks = (codes * power).sum(axis=1, dtype=np.uint64)
            order = np.argsort(marks, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[marks >> np.uint64(64 - _TABLE_BITS)] = True
            self.lengths.append((length, which[order], codes[order], marks[order], table))

    def _powers(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, b, np.uint64)]), dtype=np.uint64) for b in bases)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and how often, by text and term. Each text ends with a line end, which no term has."""
        codes = _codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        power, inverse = self._powers(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1], dtype=np.uint64)])
        places, numbers = [], []
        for length, which, own, marks, table in self.lengths:
            if length > len(codes):
                break
            seen = (sums[length:] - sums[:-length]) * inverse[:-length]
            at = np.flatnonzero(table[seen >> np.uint64(64 - _TABLE_BITS)])
            first, last = np.searchsorted(marks, seen[at]), np.searchsorted(marks, seen[at], "right")
            while len(at):  # more than once only for terms of one hash
                at, first, last = (x[first < last] for x in (at, first, last))
                same = (codes[at[:, None] + np.arange(length)] == own[first]).all(axis=1)
                places.append(at[same])
                numbers.append(which[first[same]])
                first = first + 1
        if not places:
            return (np.zeros(0, np.int64),) * 3
        of = np.searchsorted(ends, np.concatenate(places), "right")
        many = max((int(w.max()) for _, w, *_ in self.lengths), default=0) + 1
        keys, times = np.unique(of * many + np.concatenate(numbers), return_counts=True)
        return keys // many, keys % many, times


def held_terms(memories: DataFrame, terms: list[str], own: Column) -> DataFrame:
    """``id, own, seen, size, terms, tfs`` of all rows: the terms (by number) that each holds, and how often."""
    context = memories.sparkSession.sparkContext
    known = context.broadcast(terms)
    lowered = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS]
    text = F.concat(F.concat_ws("\n", *lowered), F.lit("\n"))
    seen = F.coalesce(F.unix_micros(F.col("last_seen").cast("timestamp")), F.lit(-(1 << 62)))
    rows = memories.select("id", F.coalesce(own, F.lit(False)).alias("own"), seen.alias("seen"), size_of().alias("size"), text.alias("text"))

    def run(batches):
        finder = Terms(known.value)
        for batch in batches:
            texts = batch.column(4).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_CHARS or i + 1 == len(texts):
                    of, numbers, times = finder.found(texts[start : i + 1])
                    places = pa.array(np.searchsorted(of, np.arange(i + 2 - start)), pa.int32())
                    lists = [pa.ListArray.from_arrays(places, pa.array(x, pa.int32())) for x in (numbers, times)]
                    names = ["id", "own", "seen", "size", "terms", "tfs"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, i + 1 - start) for c in range(4)), *lists], names)
                    start, size = i + 1, 0

    return rows.mapInArrow(run, "id long, own boolean, seen long, size long, terms array<int>, tfs array<int>")


class Best:
    """The best ``most`` of each group, by two values, the larger the better."""

    def __init__(self, most: int):
        self.most, self.rows, self.waiting, self.kept = most, [], 0, 0

    def add(self, group: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        self.rows.append((group, first, second))
        self.waiting += len(group)
        if self.waiting >= WAITING + self.kept:
            self.rows = [self.ranked()]
            self.kept, self.waiting = len(self.rows[0][0]), 0

    def ranked(self) -> tuple[np.ndarray, ...]:
        group, first, second = map(np.concatenate, zip(*self.rows))
        order = np.lexsort((-second, -first, group))
        group = group[order]
        new = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        place = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
        best = place < self.most
        return group[best], first[order][best], second[order][best]


def best_rows(held: DataFrame, wanted: list[tuple[int, int, int]], weights: list[float], short: list[int], mean: float, k1: float, b: float, full: int, each: int) -> DataFrame:
    """``short, key, id, score, seen``: of each task the best ``full`` rows of a question (``key``) by BM25, ties by id, and the newest
    ``each`` rows that hold a term of two characters (``key``). ``wanted``: number of a term, question and how often it has the term, by
    term; ``weights``: of each term."""
    context = held.sparkSession.sparkContext
    known = context.broadcast((np.array(wanted, np.int64).reshape(-1, 3), np.array(weights, float), np.array(short, bool)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        asked, idf, is_short = known.value
        questions, column = np.unique(asked[:, 1], return_inverse=True)
        first = np.searchsorted(asked[:, 0], np.arange(len(idf) + 1))
        best, newest = Best(full), Best(each)
        for batch in batches:
            step = max(1, BLOCK_SCORES // max(len(questions), 1))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids, seen, size = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                lists = part.column(4)
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                term, tf = (part.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
                brief = is_short[term]
                if brief.any():
                    newest.add(term[brief], seen[row[brief]], ids[row[brief]])
                row, term, tf = row[~brief], term[~brief], tf[~brief]
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean))
                count = first[term + 1] - first[term]
                of = np.repeat(first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
                cell = np.repeat(row, count) * len(questions) + column[of]
                scores = np.bincount(cell, np.repeat(weight, count) * asked[of, 2], part.num_rows * len(questions))
                cell = np.flatnonzero(scores)
                best.add(cell % max(len(questions), 1), scores[cell], -ids[cell // max(len(questions), 1)])
        for flag, top in ((False, best), (True, newest)):
            if top.rows:
                key, one, two = top.ranked()
                columns = (key, two, np.zeros(len(key)), one) if flag else (questions[key], -two, one, np.zeros(len(key), np.int64))
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), flag)), *map(pa.array, columns, types)], ["short", "key", "id", "score", "seen"])

    return held.where("own AND id IS NOT NULL AND size(terms) > 0").mapInArrow(run, "short boolean, key long, id long, score double, seen long")


def counts_of(held: DataFrame) -> tuple[int, float, dict[int, int]]:
    """Rows, their mean size, and of each term that occurs the rows with it."""
    rows, mean = held.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return rows, mean, {r.term: r.n for r in df.collect()}  # a number for each asked term


def scanned(memories: DataFrame, terms: list[str], own: Column) -> DataFrame:
    return durable(held_terms(memories, terms, own))
