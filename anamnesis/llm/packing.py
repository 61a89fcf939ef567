"""Best-fit packing of tokenised documents by the sum-of-squares rule.

An open sequence is known by its residual gap. A piece goes where the sum of the squared
numbers of open sequences per gap becomes smallest, a new sequence being one of the places; ties
go to the smallest gap left, and before a new sequence. Pieces are taken longest first.

Scale: texts become small rows (one per piece, of at most ``capacity`` tokens) in a first
pass, whose result is checkpointed. Full pieces are sequences of their own. The others
are dealt at random to groups of about ``GROUP`` pieces, each packed by one task. Sequences
that a group leaves with a gap over ``SLACK``, as the rule leaves some of each gap for pieces to
come, are taken apart, and their pieces are packed again, in fewer groups, until one group
holds the rest or a round gains nothing. In these rounds no pieces are to come, so a sequence is
opened only where no open one has room.

Defined cases: a null text counts as empty and is one piece, the end token alone; only
documents longer than ``capacity`` are cut, whatever their length; equal lengths are taken in the
order of the rows; repeated rows are packed once each; an empty
table gives an empty result; columns besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bpe import WordBpe, read_vocabulary
from anamnesis.llm.common import durable, map_rows, pick, settle

CAPACITY = 2048
END_ID = 0
#: Pieces in a group that one task packs.
GROUP = 40_000
#: A sequence with a larger gap is taken apart after a round that isn't the last.
SLACK = 8

_NO_ROOM = np.iinfo(np.int64).max
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class LibraryBpe(WordBpe):
    """The library encodes what the worker hasn't met."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(text)
        spec = json.loads(text)
        suffix = spec["model"]["end_of_word_suffix"]
        self.is_end = np.array([t.endswith(suffix) for t in self.strings])
        # texts are normalised and split already; the library gets words with spaces between
        spec |= {"normalizer": None, "truncation": None, "padding": None}
        spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.library = Tokenizer.from_str(json.dumps(spec))

    def _learn(self, chunks: list[str]) -> None:
        """One call for many chunks: a chunk has as many end marks as words."""
        for i in range(0, len(chunks), 20_000):
            part = chunks[i : i + 20_000]
            words = [self.find_words(c) for c in part]
            joined = " ".join([w for mine in words for w in mine])
            ids = np.array(self.library.encode(joined, add_special_tokens=False).ids, np.uint32)
            ends = np.concatenate([[0], np.flatnonzero(self.is_end[ids]) + 1])
            flat, last = ids.tobytes(), 0
            for chunk, end in zip(part, (4 * ends[np.cumsum([*map(len, words)])]).tolist(), strict=True):
                self.table[chunk] = flat[last:end]
                last = end


_built: dict[int, LibraryBpe] = {}


def _worker_bpe(text: str) -> LibraryBpe:
    key = hash(text)
    if key not in _built:
        _built[key] = LibraryBpe(text)
    return _built[key]


def _forget_all() -> None:
    for bpe in _built.values():
        bpe.forget()


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: ``doc_id, piece, start, length, ids_crc32``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    end = array("I", [END_ID]).tobytes()

    def rows(batches):
        bpe = _worker_bpe(vocabulary.value)
        for batch in batches:
            for key, ids in zip(batch["id"], bpe.encode_all([t or "" for t in batch["text"]])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    yield key, piece, at // 4, len(part) // 4, zlib.crc32(part)

    return map_rows(
        pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long")),
        PIECE,
        pa.schema(
            [
                ("doc_id", pa.int64()),
                ("piece", pa.int32()),
                ("start", pa.int64()),
                ("length", pa.int64()),
                ("ids_crc32", pa.int64()),
            ]
        ),
        rows,
        done=_forget_all,
    )


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its sequence and its place there, and each sequence's gap. If these are the ``last``
    pieces, a sequence is opened only where no open one has room."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        # moving a sequence from gap g to g - size changes the sum by 2 (n[g - size] - n[g] + 1)
        here = count[size:capacity]
        change = np.where(here > 0, 2 * (count[: capacity - size] - here + 1), _NO_ROOM)
        if here[0]:
            change[0] -= 1  # a full sequence no longer counts
        best = int(change.argmin())  # the first is the tightest
        new = _NO_ROOM - 1 if last else 2 * count[capacity - size] + 1
        if change[best] <= new:
            gap = best + size
            k = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, k = capacity, len(gaps)
            gaps.append(capacity)
        sequence[i], offset[i] = k, capacity - gap
        left = gap - size
        gaps[k] = left
        if left:
            open_by_gap[left].append(k)
            count[left] += 1
    return sequence, offset, np.array(gaps, np.int64)


def _packer(turn: int, capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        sequence, offset, gaps = sum_of_squares(group["length"].to_numpy().astype(np.int64), capacity, turn > 0)
        number = group["_group"][0].as_py()
        return (
            group.drop_columns("_group")
            .append_column("sequence_id", pa.array(((turn << 56) + (number << 32) + sequence) * 2))
            .append_column("offset", pa.array(offset))
            .append_column("gap", pa.array(gaps[sequence]))
        )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with ``sequence_id long``
    and ``offset long``. ``pieces`` should be read from storage: its rows are numbered by place."""
    names = pieces.columns
    fields = {f.name: f.dataType.simpleString() for f in pieces.schema}
    rows = pieces.withColumn("_row", F.monotonically_increasing_id())
    # rounds and groups are in the ids' upper bits; full pieces have odd ids
    done = [
        rows.where(F.col("length") >= capacity)
        .withColumns({"sequence_id": F.col("_row") * 2 + 1, "offset": F.lit(0).cast("long")})
        .select(*names, "sequence_id", "offset")
    ]
    rest = rows.where(F.col("length") < capacity)
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items()) + ", _row long, sequence_id long, offset long, gap long"
    left, turn = rest.count(), 0
    while left:
        groups = -(-left // group)

        dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(groups)))
        packed = durable(dealt.groupBy("_group").applyInArrow(_packer(turn, capacity), schema))
        again = packed.where(F.col("gap") > slack)
        more = again.count() if turn == 0 or groups > 1 else 0
        stop = turn > 0 and (groups == 1 or more > 0.9 * left)
        done.append((packed if stop else packed.where(F.col("gap") <= slack)).select(*names, "sequence_id", "offset"))
        rest, left, turn = again.select(*names, "_row"), 0 if stop else more, turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """All documents, packed: a row per piece with ``sequence_id`` and ``offset``."""
    settle(docs.sparkSession)
    return pack(durable(cut(docs, path, capacity, **names)), capacity)
