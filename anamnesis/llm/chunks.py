"""Texts cut where no token can cross, and what is known of the parts that come again.

A text may be cut before a space that follows a character that isn't white space: byte-level
vocabularies split words there first, and a vocabulary of pieces may have spaces only where a
piece begins, which ``SafePieces`` checks. So each part can be encoded by itself, and once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker remembers for all its tasks once they come again, and those it has met once.
COMMON = 150_000
ONCE = 300_000
#: Longer parts aren't remembered.
LONG = 64
BLOCK_CHARS = 6_000_000
#: Parts are encoded so many characters at a time.
RUN_CHARS = 10_000

cut_places = re.compile(r"(?<=\S) (?=[\s\S])").finditer


def parts_of(text: str) -> list[str]:
    """The parts of one text; they begin with a space, but for the first."""
    places = [m.start() for m in cut_places(text)]
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]


def in_parts(texts: list[str], lead: str = "") -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Blocks of texts as their distinct parts, and for each text the numbers of its parts in order;
    ``lead``, nothing or a space, stands before each text.

    Most texts have single spaces only and are split by Arrow; others one by one.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
            size += len(texts[end])
            end += 1
        block, at = texts[at:end], end
        split = pc.split_pattern(pa.array(block, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        odd = np.array([not w or w[-1].isspace() for w in words] + [False])
        which, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
        odd_before = np.concatenate([[0], np.cumsum(odd[which])])[offsets]
        names = {" " + w: i for i, w in enumerate(words)}
        out = []
        for i, text in enumerate(block):
            if odd_before[i + 1] == odd_before[i]:
                mine = which[offsets[i] : offsets[i + 1]].astype(np.int64)
                mine[0] = names.setdefault(lead + words[mine[0]], len(names))
            else:
                mine = np.array([names.setdefault(p, len(names)) for p in parts_of(lead + text)], np.int64)
            out.append(mine)
        # words of texts that were split one by one, and first words, may have no part
        used = np.bincount(np.concatenate(out), minlength=len(names)) > 0
        place = np.cumsum(used) - 1
        yield [*compress(names, used.tolist())], [place[mine] for mine in out]


def in_words(texts: pa.Array) -> Iterator[tuple[pa.Array, list[str], list[np.ndarray]]]:
    """Like ``in_parts``, with Arrow doing what can be done there: blocks of texts as their distinct words, which stand for
    parts of a space and a word, as their other distinct parts, and for each text the numbers of its parts in order. The
    others' numbers come after the words'. Null texts count as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.utf8_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_CHARS, "right")))
        block, at = texts.slice(at, end - at), end
        split = pc.split_pattern(block, " ")
        coded = split.flatten().dictionary_encode()
        words, which, offsets = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy()
        last = pc.utf8_slice_codeunits(words, -1).dictionary_encode()
        odd = np.array([not c or c.isspace() for c in last.dictionary.to_pylist()])[last.indices.to_numpy()]
        plain = np.diff(np.concatenate([[0], np.cumsum(odd[which])])[offsets]) == 0
        inner = np.repeat(plain, np.diff(offsets))
        inner[offsets[:-1]] = False
        used = np.bincount(which[inner], minlength=len(words)) > 0
        n, numbers = int(used.sum()), (np.cumsum(used) - 1)[which]
        heads = words.take(pa.array(which[offsets[:-1]])).to_pylist()
        others: dict[str, int] = {}
        out = []
        for i, head in enumerate(heads):
            if plain[i]:
                mine = numbers[offsets[i] : offsets[i + 1]]
                mine[0] = n + others.setdefault(head, len(others))
            else:
                mine = np.array([n + others.setdefault(p, len(others)) for p in parts_of(block[i].as_py())], np.int64)
            out.append(mine)
        yield words.filter(pa.array(used)), [*others], out


_MISSING = object()


class Remembered:
    """Results by part. Parts that come again outlive a task, others are forgotten at its end."""

    def __init__(self, learn: Callable[[list[str]], list]):
        self.learn, self.once, self.common = learn, {}, {}

    def __call__(self, parts: list[str]) -> list:
        once, common = self.once, self.common
        if len(once) > ONCE:
            once.clear()
        found = [*map(common.get, parts, repeat(_MISSING))]
        unknown = []
        for i, part in enumerate(parts):
            if found[i] is _MISSING:
                if (known := once.get(part, _MISSING)) is _MISSING:
                    unknown.append(i)
                else:
                    found[i] = known
                    if len(common) < COMMON:
                        common[part] = once.pop(part)
        for i, fresh in zip(unknown, self.learn([parts[i] for i in unknown]), strict=True):
            found[i] = fresh
            if len(parts[i]) <= LONG:
                once[parts[i]] = fresh
        return found

    def forget(self) -> None:
        self.once = {}


def joined(parts: list[str]) -> list[str]:
    """Parts put together where they may be cut again: each begins with a space, after one that ends without."""
    out, run, size, open_ = [], [], 0, False
    for part in parts:
        if run and (size >= RUN_CHARS or not open_ or part[0] != " "):
            out.append("".join(run))
            run, size = [], 0
        run.append(part)
        size += len(part)
        open_ = not part[-1].isspace()
    return [*out, "".join(run)] if run else out


class Vocabulary:
    """The bytes of each id, and what encodes texts into lists of ids."""

    bytes: list[bytes]
    lengths: np.ndarray
    #: Whether ids always have the bytes of their text.
    lossless = False

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def flat(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, which aren't empty, and how many have come by the end of each part. Fails with a
        ``ValueError`` if the ids' bytes aren't those of the parts, or an id goes over a part's end."""
        return self._flat(joined(parts), np.cumsum(pc.binary_length(pa.array(parts, pa.large_string())).to_numpy()))

    def flat_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that are a space and a word, which doesn't end in white space."""
        here = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        first = [*np.flatnonzero(np.diff(here // RUN_CHARS, prepend=-1)).tolist(), len(words)]
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), words), pa.scalar(" ", words.type))
        return self._flat([" " + run for run in runs.to_pylist()], here)

    def _flat(self, runs: list[str], here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not runs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lists = self.encode(runs)
        ids = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        if not self.lossless and b"".join([self.bytes[i] for i in ids.tolist()]) != "".join(runs).encode():
            raise ValueError("other bytes")
        ends = np.cumsum(self.lengths[ids])
        last = np.searchsorted(ends, here)
        if len(ends) != last[-1] + 1 or (ends[last] != here).any():
            raise ValueError("other places")
        return ids, last + 1


#: Fixed value: how byte-level vocabularies split texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel(Vocabulary):
    """A byte-level vocabulary; strings of special tokens inside texts are plain text.

    Where ids follow the order of the merges, as usual, merging by the least id is the same as by the first merge,
    and the faster of two libraries does it. Long parts go to the other one, whose time doesn't grow with their square.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(text) | {"truncation": None, "padding": None}
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        shown = {c: b for b, c in enumerate(_shown_bytes())}
        self.bytes = [b""] * self.size
        for token, i in spec["model"]["vocab"].items():
            if all(c in shown for c in token):
                self.bytes[i] = bytes(shown[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.lossless = spec["normalizer"] is None and {bytes([b]) for b in range(256)} <= {*self.bytes}
        merges, pre = spec["model"]["merges"], spec["pre_tokenizer"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        plain = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and spec["normalizer"] is None
        self.by_rank = None
        if plain and all(spec["model"]["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(pairs)):
            import tiktoken

            ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.by_rank is None:
            return self._other(texts)
        return [self.by_rank.encode_ordinary(t) if len(t) <= 2 * RUN_CHARS else self._other([t])[0] for t in texts]

    def _other(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def _shown_bytes() -> list[str]:
    """A printable character for each byte: itself if it is printable, others from 256 on in order."""
    plain = {b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Fixed value: the mark that pieces have for a space.
SPACE_MARK = "▁"


class SafePieces(Vocabulary):
    """A vocabulary of pieces with byte fallback that adds a space before a text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {i} has a space inside, so texts can't be cut at spaces")
            else:
                self.bytes.append(piece.replace(SPACE_MARK, " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each text begins with the space that the vocabulary adds."""
        return self.library.encode([t[1:] for t in texts], num_threads=1)
