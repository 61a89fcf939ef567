"""BPE encoding and decoding of whole texts.

A word's symbols form a doubly linked list; a priority queue holds the ranks of the
merges of neighbours. The best entry is taken until none is left, and entries whose
symbols have changed since they were put in are skipped. Decoding concatenates the
vocabulary's strings.

The vocabulary file (the JSON format of the ``tokenizers`` library, with byte-level
symbols and an end-of-word suffix) is read once on the driver, its size is checked,
and it is broadcast. Words repeat, so each Python worker keeps a bounded table of
what it has encoded between white space.

Defined cases: a null text counts as empty and gives no ids; texts and words of any length are
encoded whole; of merges with equal ranks the leftmost comes first; special tokens that occur
in a text become their ids; repeated rows give repeated results; an empty table gives
an empty result; columns besides the id and the text are not read, so their names
cannot clash.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import map_rows, pick

#: A vocabulary file may be this large; it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Texts between white space that a worker remembers within a task, and of those that come again,
#: for all its tasks. Longer ones it forgets.
CHUNKS_REMEMBERED = 400_000
COMMON_CHUNKS = 150_000
LONG_CHUNK = 64
BLOCK_CHARS = 6_000_000


def char_class(*categories: str) -> str:
    """Ranges of the code points whose general category starts so, for a regex class."""
    parts, start = [], None
    for point in range(sys.maxunicode + 2):
        inside = point <= sys.maxunicode and unicodedata.category(chr(point))[0] in categories
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            parts.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(parts)


#: The code points of Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"


split_space = re.compile(f"[{SPACE}]+").split
#: Controls that Python's ``split`` takes for white space, but the property doesn't have.
has_controls = re.compile("[\x1c-\x1f]").search


def _byte_symbols() -> list[str]:
    """A printable character for each byte: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, other = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else other))
        other += b not in shown
    return out


class WordBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        # ids of symbol pairs to the rank and the id of their merge
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        symbols = _byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        letters, numbers = char_class("L"), char_class("N")
        # the alternatives begin with different characters, but for the last two
        self.find_words = re.compile(
            f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{letters}{numbers}]+"
        ).findall
        special = re.compile(f"({'|'.join(map(re.escape, self.special))})")
        self.split_special, self.has_special = special.split, special.search
        self.table: dict[str, bytes] = {}
        self.common: dict[str, bytes] = {}  # chunks of more than one block; they outlive a task

    def forget(self) -> None:
        self.table = {}

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        end, merges = len(symbols), self.merges
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = []
        for i in range(end - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if symbols[i] != left or j == end or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if found := merges.get((merged, symbols[k])):
                    heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            if (k := before[i]) >= 0 and (found := merges.get((symbols[k], merged))):
                heappush(queue, (found[0], k, symbols[k], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def _learn(self, chunks: list[str]) -> None:
        for chunk in chunks:
            ids = [i for word in self.find_words(chunk) for i in self.encode_word(word)]
            self.table[chunk] = array("I", ids).tobytes()

    def _prepare(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """White space always ends a word, so what stands between can be encoded by itself."""
        table, common = self.table, self.common
        if len(table) > CHUNKS_REMEMBERED:
            table.clear()
        room = COMMON_CHUNKS - len(common)
        for chunk in [c for c in chunks if c in table][: max(room, 0)]:
            common[chunk] = table.pop(chunk)
        if unknown := [c for c in chunks if c not in common and c not in table]:
            self._learn(unknown)
        out = [common[c] if c in common else table[c] for c in chunks]
        for chunk in unknown:
            if len(chunk) > LONG_CHUNK:
                del table[chunk]
        return out

    def _plain(self, text: str) -> bytes:
        chunks = split_space(self._prepare(text))
        known = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
        found = self._encode_chunks([*known])
        return b"".join([found[known[c]] for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.split_special(text)
        return b"".join(
            array("I", [self.special[p]]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts)
        )

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` for many texts, in blocks of about ``BLOCK_CHARS``. Splitting and looking up
        what repeats are array operations; texts with special tokens or odd controls go singly."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
                size += len(texts[end])
                end += 1
            block, at = texts[at:end], end
            single = {i for i, t in enumerate(block) if self.has_special(t) or has_controls(t)}
            array_ = pa.array(["" if i in single else self._prepare(t) for i, t in enumerate(block)], pa.large_string())
            pieces = pc.utf8_split_whitespace(array_)
            # empty pieces stand where white space begins or ends a text; they have no ids
            coded = pieces.flatten().dictionary_encode()
            found = self._encode_chunks(coded.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(found), np.uint32)
            count = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(count) - count
            which = coded.indices.to_numpy()
            sizes = count[which]
            ends = np.cumsum(sizes)
            ids = flat[np.repeat(first[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            text_ends = np.concatenate([[0], ends])[pieces.offsets.to_numpy()] * 4
            for i, (a, b) in enumerate(zip(text_ends[:-1].tolist(), text_ends[1:].tolist())):
                yield self.encode(block[i]) if i in single else ids[a:b]

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings with a space between, as without a decoder rule."""
        numbers = array("I")
        numbers.frombytes(ids)
        return " ".join([self.strings[i] for i in numbers])


_built: dict[int, WordBpe] = {}


def worker_bpe(text: str) -> WordBpe:
    """The worker's encoder for this vocabulary; it is built once."""
    key = hash(text)
    if key not in _built:
        _built[key] = WordBpe(text)
    return _built[key]


def forget_all() -> None:
    for bpe in _built.values():
        bpe.forget()


def read_vocabulary(path: str) -> str:
    file = Path(path)
    if file.stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return file.read_text(encoding="utf-8")


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_tokens``, ``ids`` (little-endian unsigned
    32-bit integers) and ``decoded``, the text that those ids give."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def rows(batches):
        bpe = worker_bpe(vocabulary.value)
        for batch in batches:
            for key, ids in zip(batch["id"], bpe.encode_all([t or "" for t in batch["text"]])):
                yield key, len(ids) // 4, ids, bpe.decode(ids)

    return map_rows(
        pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long")),
        f"{id_col} long, n_tokens long, ids binary, decoded string",
        pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]),
        rows,
        lambda row: 64 + len(row[2]) + len(row[3]),
        forget_all,
    )
