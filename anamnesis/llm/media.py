"""Media columns: texts as WAV sound, and spectral fingerprints of it.

A text's UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64, become the
8-bit samples of a mono WAV file. The samples are read back with the ``wave`` module.
A short-time Fourier transform over blocks of frames gives in each frame the strongest bin of four bands; bins above the frame's mean
are peaks. Frames overlap by half, the first beginning half a frame before the text, so
that windows sum to about one at each sample. A peak is paired with all peaks of the next
``REACH`` frames, and each pair is stored as ``time << 32 | bin << 22 | other bin << 12 | distance in time``. Pairs are made
and given out in parts, so that what a task holds is a few times the longest text, whatever its number of pairs.

Defined cases: a null text counts as empty and becomes 64 zero samples, which have no
peaks; texts of any length are transformed whole, in blocks; of equally strong bins in a band the lowest is
the peak; equal texts give equal values; repeated rows give repeated results; an empty
table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import map_rows, pick

RATE = 8000
FRAME = 256
HOP = FRAME // 2
#: First bins of the bands, and the end of the last.
BANDS = (2, 9, 25, 57, 129)
#: A peak is paired with later peaks so many frames away at most.
REACH = 16
#: More partners than this a peak cannot have.
FAN = REACH * (len(BANDS) - 1)
#: Frames transformed at once.
BLOCK = 512
#: Pairs of a part, about; a text's pairs take sixteen times its memory, so those of long texts are given in parts.
PART_PAIRS = 1 << 18
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(-len(raw) % 64, 64 * (not raw)))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectra(samples: np.ndarray, hop: int = FRAME) -> Iterator[np.ndarray]:
    """Magnitudes by frame and bin, in blocks of frames; before the first and after the last is silence."""
    lead = FRAME - hop
    count = max(1, -(-(lead + len(samples)) // hop))
    for start in range(0, count, BLOCK):
        n = min(BLOCK, count - start)
        part = np.full((n - 1) * hop + FRAME, 128, np.float32)
        first = start * hop - lead
        here = samples[max(first, 0) : first + len(part)]
        part[max(-first, 0) :][: len(here)] = here
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::hop]
        frames = (frames - frames.mean(axis=1, keepdims=True)) * _WINDOW
        yield np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)


def fingerprints(payload: bytes, hop: int = FRAME) -> Iterator[np.ndarray]:
    """Spectral-peak pairs in order of time, by blocks of frames; a frame begins ``hop`` samples after the one before.
    Peaks wait until all that they are paired with are known, so no more than a block and its reach is held."""
    t, b, passed = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for block in chain(spectra(np.frombuffer(payload, np.uint8), hop), [None]):
        if block is not None:
            level = block.mean(axis=1)
            times, bins = [t], [b]
            for low, high in zip(BANDS, BANDS[1:]):
                best = block[:, low:high].argmax(axis=1) + low
                frames = np.flatnonzero(block[np.arange(len(block)), best] > 1.5 * level + 1e-3)
                times.append(frames + passed)
                bins.append(best[frames])
            t, b = np.concatenate(times), np.concatenate(bins)
            order = np.lexsort((b, t))
            t, b, passed = t[order], b[order], passed + len(block)
        ready = len(t) if block is None else np.searchsorted(t, passed - REACH)
        later = np.searchsorted(t, t[:ready], side="right")
        fan = np.searchsorted(t, t[:ready] + REACH, side="right") - later
        at = np.repeat(np.arange(ready), fan)
        j = np.arange(len(at)) + np.repeat(later - (np.cumsum(fan) - fan), fan)
        yield np.sort(t[at] << 32 | b[at] << 22 | b[j] << 12 | (t[j] - t[at]))
        t, b = t[ready:], b[ready:]


def parts_of(payload: bytes) -> Iterator[tuple[int, np.ndarray, str, bool]]:
    """Pairs in parts of some ``PART_PAIRS``: how many came up to the part's end, the part, the digest of all up to
    there (as little-endian 64-bit integers), and whether it is the last."""
    digest, held, size, total = hashlib.sha256(), [], 0, 0
    for pairs in fingerprints(payload, HOP):
        if size >= PART_PAIRS:
            total += size
            yield total, np.concatenate(held), digest.hexdigest(), False
            held, size = [], 0
        digest.update(pairs.astype("<i8").tobytes())
        held.append(pairs)
        size += len(pairs)
    yield total + size, np.concatenate(held), digest.hexdigest(), True


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs`` one row or, if it has many pairs, several, in order of ``part``: the id, ``n_bytes`` of the
    text, ``part`` (from 0), ``pairs`` (array of time-coded peak pairs), ``n_pairs`` and ``pairs_sha256`` (up to this
    part's end), ``last``; the last part has ``media`` (the WAV file) and ``payload`` (its samples, read back)."""

    def rows(batches):
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                media = write_wav(to_payload(text))
                payload, size = read_wav(media), len((text or "").encode())
                for part, (total, pairs, digest, last) in enumerate(parts_of(payload)):
                    yield key, size, media if last else None, payload if last else None, part, pairs, total, digest, last

    return map_rows(
        pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long")),
        f"{id_col} long, n_bytes long, media binary, payload binary, part int, pairs array<long>, n_pairs long, pairs_sha256 string, last boolean",
        pa.schema(
            [
                (id_col, pa.int64()),
                ("n_bytes", pa.int64()),
                ("media", pa.binary()),
                ("payload", pa.binary()),
                ("part", pa.int32()),
                ("pairs", pa.list_(pa.int64())),
                ("n_pairs", pa.int64()),
                ("pairs_sha256", pa.string()),
                ("last", pa.bool_()),
            ]
        ),
        rows,
        lambda row: 128 + len(row[2] or b"") + len(row[3] or b"") + 8 * len(row[5]),
    )
