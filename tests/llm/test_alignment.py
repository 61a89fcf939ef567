"""Two tokenizers' tokens aligned, beside a plain version on whole texts."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anamnesis.llm import alignment
from anamnesis.llm.chunks import ByteLevel, SafePieces, in_parts

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
HARD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b \n b\t\r\n x", "a \n \nb", "ñ é 本語で書く", "x▁y", "\x00\x1c y\x85 z", "<s> <0x41> <|endoftext|></s>",
    "it's John's 12345 67", "= = ======   q", "word " * 700, "語" * 900, "same text", "same text", "ﬁ½ 😀😀👨‍👩‍👧",
]


def plain(docs):
    """By whole texts, sets of ends and pairs one by one."""
    letters = {c: b for b, c in enumerate(_letters())}
    groups_of = []
    for text in docs:
        full = (" " + (text or "")).encode()
        a, b = A.encode(" " + (text or ""), add_special_tokens=False).ids, B.encode(text or "")
        a_bytes = [bytes(letters[c] for c in A.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != full or b"".join(b_bytes) != full:
            groups_of.append(None)
            continue
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (a_bytes, b_bytes)]
        groups, last = [], 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            groups.append(tuple([i for i, e in zip(ids, mine) if last < e <= end] for ids, mine in zip((a, b), ends)))
            last = end
        groups_of.append(groups)
    held, top = Counter(), defaultdict(int)
    links_of = [g and [(x, y) for mine in g for x in mine[0] for y in mine[1]] for g in groups_of]
    for links in links_of:
        held.update(set(links or ()))
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for k, (groups, links) in enumerate(zip(groups_of, links_of)):
        if not groups:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        n_a, n_b = (sum(len(g[s]) for g in groups) for s in (0, 1))
        best = sum(held[p] == top[p[0]] for p in links)
        out.append((k, n_a, n_b, len(groups), len(links), best, sum(held[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def _letters():
    plain_ones = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain_ones]
    return [chr(b) if b in plain_ones else chr(256 + others.index(b)) for b in range(256)]


@pytest.mark.parametrize("limit", [1_000_000, 40, 0])
def test_equal_to_a_plain_version(spark, limit):
    """Also with only some pairs broadcast, and with none."""
    rows = spark.createDataFrame([*enumerate(HARD)], "doc_id long, text string")
    rows = rows.withColumns({"x": F.lit(1), "pair": F.lit(2)}).toDF("doc_id", "text", "TEXT", "pair")
    got = alignment.align(rows, A_PATH, B_PATH, limit).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain(HARD)


def test_groups_counted_by_distinct_ids():
    with pytest.MonkeyPatch.context() as patch:
        aligner = alignment.Aligner(open(A_PATH).read(), open(B_PATH, "rb").read())
        texts = [t for t in HARD if t]
        usual = [f and (f[0], f[1], f[2].tolist(), f[3].tolist()) for f in aligner.align_all(texts)]
        patch.setattr(alignment, "LARGE_GROUP", 0)
        aligner.known = alignment.Remembered(aligner._learn)
        assert [f and (f[0], f[1], f[2].tolist(), f[3].tolist()) for f in aligner.align_all(texts)] == usual


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(rows, A_PATH, B_PATH).count() == 0


WORDS = st.text(st.sampled_from("ab '1.=\n\t 　\x1c\x85语é"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5))
def test_parts_are_encoded_as_whole_texts_are(texts):
    a, b = ByteLevel(open(A_PATH).read()) if not _made else _made[0], _made[1] if _made else SafePieces(open(B_PATH, "rb").read())
    _made[:] = [a, b]
    for lead in ("", " "):
        for parts, numbers in in_parts(texts, lead):
            assert ["".join(parts[k] for k in mine) for mine in numbers] == [lead + t for t in texts]
            for text, mine in zip(texts, numbers):
                mine = [parts[k] for k in mine if parts[k]]
                ids, ends = a.flat(mine)
                assert ids.tolist() == A.encode(lead + text, add_special_tokens=False).ids
                assert [b"".join(a.bytes[i] for i in part.tolist()).decode() for part in np.split(ids, ends)[:-1]] == mine
                if lead and text:
                    assert b.flat(mine)[0].tolist() == B.encode(text)


_made: list = []


def test_pieces_with_spaces_inside_are_refused(monkeypatch):
    class Odd:
        def __init__(self, model_proto):
            pass

        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")
        is_byte = staticmethod(lambda i: False)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError, match="space inside"):
        SafePieces(b"")


def test_common_pairs_fit_the_limit(spark):
    counts = spark.createDataFrame([(i, 1 + i) for i in range(100)], "pair int, held long")
    for limit in (0, 1, 37, 100):
        least = alignment.common_pairs(counts, limit)
        assert counts.where(F.col("held") >= least).count() <= limit


def test_vocabulary_file_is_a_byte_level_one():
    assert json.load(open(A_PATH))["pre_tokenizer"]["type"] == "ByteLevel"
