"""Two tokenizers' tokens of the same text, aligned by the bytes at which both end.

Each byte has a label: no token ends there, one of A, one of B, or one of both. A regular
expression takes the spans up to each label "both"; the labels counted in a span say how many of
A's and B's next tokens form its group. All pairs of an A and a B token in a group are links;
the corpus says in how many documents a pair of ids is linked.

Scale: texts are encoded once, where they lie; a part between safe cuts (``chunks.py``) ends
with a label "both", so groups lie within parts, and a part that comes again is aligned once.
Rows of (document, pair, times) aren't stored or shuffled whole: documents keep theirs in an array; they are
counted with partial sums, and looked up beside a broadcast of the common pairs, at most
``BROADCAST_PAIRS`` of them. Only pairs rarer than those are joined by a shuffle, and no such
pair is in many documents, so that no key is hot.

Defined cases: a text that is null, empty, or whose joined tokens' bytes differ from space and
text in either vocabulary has no tokens: zeros, and an empty string; ties for an id's highest count all are best; repeated rows are
documents of their own; texts of any length are taken whole (a run without a safe cut goes to the
libraries in one piece); an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bpe import MAX_VOCABULARY_BYTES, read_vocabulary
from anamnesis.llm.chunks import SPACE_MARK, ByteLevel, Remembered, SafePieces, in_parts
from anamnesis.llm.common import bounded, durable, pick, release, settle

#: Pairs of ids that are broadcast at most, those in most documents first.
BROADCAST_PAIRS = 1_000_000
#: A pair of ids is one number: the A id times this and the B id.
STEP = 1 << 15
#: Links of a group above which they are counted by distinct ids.
LARGE_GROUP = 1 << 14
#: Output goes out after about this many bytes.
FLUSH_BYTES = 8 << 20

A_END, B_END = 1, 2
spans = re.compile(b"[^\x03]*\x03", re.DOTALL).finditer
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Part(NamedTuple):
    """A part's groups as text, its linked pairs as bytes of integers, how often each is linked if that isn't once, and
    counts of A and B tokens, groups and links."""

    groups: str
    pairs: bytes
    times: np.ndarray | None
    counts: tuple[int, int, int, int]


class Aligner:
    def __init__(self, byte_level: str, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level), SafePieces(pieces)
        if len(self.b.bytes) > STEP or self.a.size * STEP >= 1 << 31:
            raise ValueError("the vocabularies are too large for pairs of ids in 32 bits")
        # what stands in a digest for an A id within a group and at its end, then for a B id
        self.shown = [f"{i}{c}" for size, ends in ((self.a.size, ",|"), (len(self.b.bytes), ",;")) for c in ends for i in range(size)]
        self.known = Remembered(self._learn)

    def _learn(self, parts: list[str]) -> list[Part | None]:
        """What is known of each part; None if the tokens' bytes differ from it."""
        plain = [p for p in parts if SPACE_MARK not in p]  # a mark of its own comes back as a space
        try:
            found = self._aligned(plain)
        except ValueError:
            found = []
            for part in plain:
                try:
                    found += self._aligned([part])
                except ValueError:
                    found.append(None)
        known = dict(zip(plain, found, strict=True))
        return [known.get(p) for p in parts]

    def _aligned(self, parts: list[str]) -> list[Part]:
        if not parts:
            return []
        (a, part_a), (b, part_b) = self.a.flat(parts), self.b.flat(parts)
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        labels = np.zeros(ends_a[-1], np.uint8)
        labels[ends_a - 1] = A_END
        labels[ends_b - 1] |= B_END
        # a span's tokens are those that end in it: labels counted from one span's end to the next
        ends = np.fromiter((m.end() for m in spans(labels.tobytes())), np.int64)
        to_a, to_b = np.cumsum(labels & A_END > 0, dtype=np.int64)[ends - 1], np.cumsum(labels & B_END > 0, dtype=np.int64)[ends - 1]
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        from_a, from_b = to_a - n_a, to_b - n_b
        part_group = np.searchsorted(to_a, part_a) + 1
        # digests: A's ids of a group, then B's
        size_a, size_b = self.a.size, len(self.b.bytes)
        codes = np.empty(len(a) + len(b), np.int64)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[to_a - 1], b_last[to_b - 1] = size_a, size_b
        codes[np.arange(len(a)) + np.repeat(from_b, n_a)] = a + a_last
        codes[np.arange(len(b)) + np.repeat(to_a, n_b)] = b + b_last + 2 * size_a
        shown = [self.shown[c] for c in codes.tolist()]
        # links: all pairs of a group's ids; those of a very large one are counted by distinct ids
        links = n_a * n_b
        large = np.flatnonzero(links > LARGE_GROUP)
        listed = np.where(links > LARGE_GROUP, 0, links)
        within = np.arange(listed.sum()) - np.repeat(np.cumsum(listed) - listed, listed)
        width = np.repeat(n_b, listed)
        pairs = (a[np.repeat(from_a, listed) + within // width] * STEP + b[np.repeat(from_b, listed) + within % width]).astype(np.int32).tobytes()
        total, all_links = [0, *(4 * np.cumsum(listed)).tolist()], [0, *np.cumsum(links).tolist()]
        out, last, last_a, last_b, last_large = [], 0, 0, 0, 0
        for end, end_a, end_b, end_large in zip(part_group.tolist(), part_a.tolist(), part_b.tolist(), np.searchsorted(large, part_group).tolist()):
            counts = end_a - last_a, end_b - last_b, end - last, all_links[end] - all_links[last]
            mine, times = pairs[total[last] : total[end]], None
            for g in large[last_large:end_large].tolist():
                ids_a, often_a = np.unique(a[from_a[g] : to_a[g]], return_counts=True)
                ids_b, often_b = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
                times = np.ones(len(mine) // 4, np.int64) if times is None else times
                mine += (ids_a[:, None] * STEP + ids_b).astype(np.int32).tobytes()
                times = np.concatenate([times, (often_a[:, None] * often_b).ravel()])
            out.append(Part("".join(shown[last_a + last_b : end_a + end_b]), mine, times, counts))
            last, last_a, last_b, last_large = end, end_a, end_b, end_large
        return out

    def align_all(self, texts: list[str]):
        """For each text None, or its four counts, the digest of its groups, and its pairs with how often
        each is linked."""
        for parts, numbers in in_parts(texts, " "):
            found = self.known(parts)
            bad = np.array([p is None for p in found])
            odd = np.array([p is not None and p.times is not None for p in found])
            counts = np.array([p.counts if p else (0,) * 4 for p in found])
            for mine in numbers:
                if bad[mine].any():
                    yield None
                    continue
                here = [found[k] for k in mine.tolist()]
                digest = hashlib.sha256("".join([p.groups for p in here])[:-1].encode())
                flat = np.frombuffer(b"".join([p.pairs for p in here]), np.int32)
                if odd[mine].any():
                    times = np.concatenate([np.ones(len(p.pairs) // 4, np.int64) if p.times is None else p.times for p in here])
                    order = np.argsort(flat, kind="stable")
                    flat, times = flat[order], times[order]
                    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                    often = np.add.reduceat(times, first)
                else:
                    flat = np.sort(flat)
                    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                    often = np.diff(first, append=len(flat))
                yield counts[mine].sum(axis=0).tolist(), digest.hexdigest(), flat[first], often


_built: dict[int, Aligner] = {}

LINK = pa.struct([pa.field("pair", pa.int32()), pa.field("times", pa.int64())])
ARROW = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in COUNTS), ("groups_sha256", pa.string()), ("links", pa.list_(LINK))]
)
SCHEMA = f"doc_id long, {', '.join(f'{n} long' for n in COUNTS)}, groups_sha256 string, links array<struct<pair:int,times:long>>"


def _batch(ids: list, found: list) -> pa.RecordBatch:
    nothing = ([0] * 4, "", np.empty(0, np.int32), np.empty(0, np.int64))
    rows = [f or nothing for f in found]
    ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
    links = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([r[2] for r in rows])), pa.array(np.concatenate([r[3] for r in rows]))], fields=[*LINK]
    )
    columns = [pa.array(ids, pa.int64()), *(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(4))]
    columns += [pa.array([r[1] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends), links)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its counts, the digest of its groups, and ``links``, an array of its
    distinct pairs (A id times ``STEP`` plus B id) with how often each is linked."""
    if Path(pieces).stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{pieces} is larger than {MAX_VOCABULARY_BYTES} bytes")
    files = docs.sparkSession.sparkContext.broadcast((read_vocabulary(byte_level), Path(pieces).read_bytes()))

    def run(batches):
        key = hash(files.value)
        if key not in _built:
            _built[key] = Aligner(*files.value)
        aligner = _built[key]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            held, weight, at = [], 0, 0
            filled = iter(aligner.align_all([t for t in texts if t]))
            for i, text in enumerate(texts):
                held.append(next(filled) if text else None)
                weight += 200 + (12 * len(held[-1][2]) if held[-1] else 0)
                if weight >= FLUSH_BYTES:
                    yield _batch(ids[at : i + 1], held)
                    held, weight, at = [], 0, i + 1
            if held:
                yield _batch(ids[at:], held)
        aligner.known.forget()
        release()

    bounded(docs.sparkSession)
    rows = pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, SCHEMA)


def common_pairs(counts: DataFrame, limit: int = BROADCAST_PAIRS) -> int:
    """The least number of documents of pairs that are broadcast: a power of two, so that at most ``limit`` pairs
    have as many."""
    rows = counts.groupBy(F.floor(F.log2("held")).cast("int").alias("size")).count().collect()  # at most 63 rows
    least, total = 1 << 62, 0
    for row in sorted(rows, key=lambda r: -r["size"]):
        total += row["count"]
        if total > limit:
            break
        least = 1 << row["size"]
    return least


def align(docs: DataFrame, byte_level: str, pieces: str, limit: int = BROADCAST_PAIRS, **names: str) -> DataFrame:
    """A row per document: counts, ``n_best`` (links whose pair is its A id's most common one over all
    documents), ``count_sum`` (over links, the documents that have the pair) and the digest of its groups."""
    settle(docs.sparkSession)
    linked = durable(aligned(docs, byte_level, pieces, **names).withColumn("row", F.monotonically_increasing_id()))
    listed = linked.select("row", F.inline("links"))
    counts = durable(listed.groupBy("pair").agg(F.count("*").alias("held")))
    by_a = counts.withColumn("a", F.shiftright("pair", 15))
    top = by_a.groupBy("a").agg(F.max("held").alias("top"))  # one row for each id of the vocabulary at most
    judged = by_a.join(F.broadcast(top), "a").select("pair", "held", (F.col("held") == F.col("top")).alias("best"))
    least = common_pairs(counts, limit)
    looked_up = listed.join(F.broadcast(judged.where(F.col("held") >= least)), "pair", "left")
    found = looked_up.where("held IS NOT NULL")
    if least > 1:
        rare = looked_up.where("held IS NULL").select("row", "pair", "times")
        found = found.unionByName(rare.join(judged.where(F.col("held") < least).hint("shuffle_hash"), "pair"))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("held")).alias("count_sum"),
    )
    digests = linked.select("row", "doc_id", *COUNTS, "groups_sha256")
    filled = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_best", "count_sum")]
    return digests.join(sums, "row", "left").select("doc_id", *COUNTS, *filled, "groups_sha256")
