"""Secret scans through nested encodings.

Each text is scanned for assigned secrets, access keys and long hex runs. A worklist then
unwraps layers: percent escapes, Unicode escapes, base64 runs (whole, over lines of equal width,
and from signs on that may be borders), and gzip or zlib data in them. Every new layer is scanned again and may hold further layers, until nothing new
comes out. A layer whose text has been met is skipped, so cycles end. Each character of
a layer knows the code points of the document that it came from, so that all spans are
given in the document's own positions.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; spans that
several layers give count once, and the base one stands for equals; repeated rows give repeated
results; an empty table gives an empty result; columns besides the id and the text are not read. Of
compressed data all members are unpacked, and what follows them is read too. What is longer
than ``MAX_UNPACKED`` bytes is held and scanned in windows of about that size, against
decompression bombs. A window ends at a byte that no pattern takes in; only within a stretch
that has none for a whole window, windows overlap by ``OVERLAP`` bytes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import map_rows, pick

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs of 24 or more
MIN_ASSIGNED, MIN_ACCESS = 6, 20
MAX_UNPACKED, OVERLAP = 64 << 20, 1 << 20
#: Bytes that are packed and unpacked at once.
PACKED, PIECE = 64 << 10, 1 << 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
LEAST_RUN = 16
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
#: Signs of base64 that may also stand before it.
BORDER = re.compile(r"[/_+-]")
#: Bytes that no pattern takes in, also not in UTF-16, and those that no base64 run has.
APART, NO_BASE64 = re.compile(rb"""[^A-Za-z0-9+/_.=\- "':%\\{}&#;\x00]"""), re.compile(rb"[^A-Za-z0-9+/_-]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (start, number of the kind, end), each kind leftmost and without overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text whose characters map to spans of the document.

    ``marks`` holds segments (start here, start there, end there, one to one?): in a
    segment that is one to one each character has its own place, in others all
    characters stand for the whole span.
    """

    def __init__(self, text: str, marks: list[tuple[int, int, int, bool]], path: str):
        self.text, self.marks, self.path = text, marks, path
        self.starts = [m[0] for m in marks]

    def place(self, i: int) -> tuple[int, int]:
        here, start, end, single = self.marks[bisect_right(self.starts, i) - 1]
        return (start + i - here, start + i - here + 1) if single else (start, end)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.place(start)[0], self.place(end - 1)[1]

    def segments(self, start: int, end: int, at: int) -> list[tuple[int, int, int, bool]]:
        """The marks of ``text[start:end]`` moved to ``at`` in a new layer."""
        out = []
        k = bisect_right(self.starts, start) - 1
        while k < len(self.marks) and self.marks[k][0] < end:
            here, first, last, single = self.marks[k]
            skip = max(0, start - here)
            out.append((at + max(here, start) - start, first + skip * single, last, single))
            k += 1
        return out

    def replaced(self, pieces: list[tuple[int, int, str]], path: str) -> Layer:
        """A layer in which each (start, end, decoded) stands decoded."""
        texts, marks, length, last = [], [], 0, 0
        for start, end, decoded in [*pieces, (len(self.text), len(self.text), "")]:
            if start > last:
                texts.append(self.text[last:start])
                marks += self.segments(last, start, length)
                length += start - last
            if decoded:
                texts.append(decoded)
                marks.append((length, *self.span(start, end), False))
                length += len(decoded)
            last = end
        return Layer("".join(texts), marks, f"{self.path}{path}>")


def _percent(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in PERCENT.finditer(text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            raw = raw.decode()
        except UnicodeDecodeError:  # the bytes that aren't UTF-8 become marks of replacement
            at = m.start()
            for c in raw.decode(errors="surrogateescape"):
                bad = "\udc80" <= c <= "\udcff"
                end = at + 3 * (1 if bad else len(c.encode()))
                out.append((at, end, "\ufffd" if bad else c))
                at = end
            continue
        if len(raw) * 3 == len(m[0]):  # one byte each: keep each character's own place
            out += [(m.start() + 3 * i, m.start() + 3 * i + 3, c) for i, c in enumerate(raw)]
        else:
            out.append((m.start(), m.end(), raw))
    return out


def _escaped(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in ESCAPE.finditer(text):
        try:
            if m[2]:
                units = bytes.fromhex(m[2].replace("\\u", ""))
                decoded = units.decode("utf-16-be", "replace")
                if len(decoded) * 6 == len(m[2]):
                    out += [(m.start() + 6 * i, m.start() + 6 * i + 6, c) for i, c in enumerate(decoded)]
                    continue
            else:
                decoded = chr(int(m[5])) if m[5] else chr(int(m[1] or m[3] or m[4], 16))
                decoded.encode()  # no lone surrogates
        except (UnicodeError, ValueError, OverflowError):
            continue
        out.append((m.start(), m.end(), decoded))
    return out


def _texts(raw: bytes) -> list[str]:
    """What bytes may say; those that fit no encoding become marks of replacement."""
    out = [raw.decode(errors="replace")]
    if b"\0" in raw:  # letters of UTF-16, also from an odd place on
        out += [raw.decode(kind, "replace") for kind in ("utf-16-le", "utf-16-be")]
    return out


def _lossless(raw: bytes) -> str | None:
    """The text, if bytes are nothing but text."""
    for kind, fits in (("utf-16", raw[:2] in (b"\xff\xfe", b"\xfe\xff")), ("utf-16-le", not any(raw[1::2])), ("utf-16-be", not any(raw[::2])), ("utf-8", True)):
        if fits:
            try:
                return raw.decode(kind)
            except UnicodeDecodeError:
                pass
    return None


def _is_packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 1 and int.from_bytes(raw[:2]) % 31 == 0)


class _Packing:
    """A layer of bytes on the way through the worklist: undecided, packed (then ``unpack`` is the member at hand,
    or None between two), or plain (then it has a number)."""

    __slots__ = ("begun", "first", "head", "number", "packed", "tail", "unpack")

    def __init__(self):
        self.head, self.first, self.number, self.packed, self.unpack, self.begun, self.tail = b"", b"", 0, False, None, b"", b""


def _unpacked(source: Iterator[bytes], path: str) -> Iterator[tuple[Iterator[bytes], str]]:
    """The streams of bytes that aren't packed any more, each to be read before the next, with their paths."""
    for (_, depth), pieces in groupby(_plain(source), key=lambda piece: piece[:2]):
        yield (raw for _, _, raw in pieces), path + ">compressed" * depth


def _plain(source: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Pieces as (number of their stream, depth, bytes). A worklist of (depth, piece or None at its end): a layer's output
    goes on the list for the layer below it, so any number of layers is unpacked without recursion. A layer that
    begins like one above it holds itself and is left packed. All members of a layer give one layer below; what
    follows them, or can't be unpacked, is a stream of its own after it."""
    layers, met, numbers = [_Packing()], set(), count(1)
    for given in chain(source, [None]):
        work = [(0, given)]
        while work:
            depth, piece = work.pop()
            layer = layers[depth]
            if layer.number:
                if piece:
                    yield layer.number, depth, piece
                continue
            if not layer.packed:
                layer.head += piece or b""
                if piece is not None and len(layer.head) < PACKED:
                    continue
                # beginnings of the same size, so that data that holds itself is known by its own
                first, head, layer.head = hashlib.sha256(layer.head[:PACKED]).digest(), layer.head, b""
                work += [(depth, None)] * (piece is None) + [(depth, head)]
                if _is_packed(head) and first not in met:
                    met.add(first)
                    layers.append(_Packing())
                    layer.packed, layer.unpack, layer.begun = True, zlib.decompressobj(47), b""
                else:
                    layer.number = next(numbers)
                continue
            if piece is None:  # a member that breaks off without a result is shown as it is
                rest, layer.unpack, layer.number = layer.begun if layer.unpack else layer.tail, None, next(numbers)
                work += [(depth, rest), (depth + 1, None)]
                continue
            data, layer.tail = layer.tail + piece, b""
            if layer.unpack is None:
                if len(data) < 2:
                    layer.tail = data
                    continue
                if not _is_packed(data):
                    layer.number = next(numbers)
                    work += [(depth, data), (depth + 1, None)]
                    continue
                layer.unpack, layer.begun = zlib.decompressobj(47), b""
            try:
                out = layer.unpack.decompress(data, PIECE)
            except zlib.error:
                layer.unpack, layer.number = None, next(numbers)
                work += [(depth, data if layer.begun is None else layer.begun + data), (depth + 1, None)]
                continue
            more = layer.unpack.unconsumed_tail
            if layer.unpack.eof:
                more, layer.unpack = layer.unpack.unused_data, None
            if out:
                layer.begun = None
            elif layer.begun is not None:
                layer.begun += data[: len(data) - len(more)]
            if more or (out and layer.unpack):
                work.append((depth, more))
            if out:
                work.append((depth + 1, out))


def _cut(raw: bytes) -> Iterator[bytes]:
    return (raw[i : i + PACKED] for i in range(0, len(raw), PACKED))


def _windows(source: Iterator[bytes]) -> Iterator[bytes]:
    """The stream in windows, none of which ends within what a pattern could match."""
    held, size = [], 0
    for piece in source:
        held.append(piece)
        size += len(piece)
        if size < MAX_UNPACKED:
            continue
        raw = b"".join(held)
        keep = _last(APART, raw)
        if keep:
            end = keep
        else:
            end, run = len(raw), _last(NO_BASE64, raw)
            keep = max(1, end - OVERLAP)
            keep += (run - keep) % 4 if keep > run else 0  # base64 goes on in step
        yield raw[:end]
        held, size = [raw[keep:]], len(raw) - keep
    if size:
        yield b"".join(held)


def _last(pattern: re.Pattern[bytes], raw: bytes) -> int:
    """The place after the last match of a single byte, 0 without any."""
    end = len(raw)
    while end:
        start = max(0, end - PACKED)
        if places := [m.end() for m in pattern.finditer(raw, start, end)]:
            return places[-1]
        end = start
    return 0


def _decoded(run: str) -> bytes:
    """The bytes of a run; a last letter that none can end with falls away."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    return binascii.a2b_base64(run + "=" * (-len(run) % 4))


def _base64(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs as (start, end, run), none within another; lines that go on at equal width are one run."""
    last = 0
    for m in BASE64.finditer(text):
        if m.start() < last:
            continue
        start, end, parts = m.start(), m.end(), [m[0]]
        # the first line may have words before it; all but the last have the width of the second, if there are more
        while not parts[-1].endswith("=") and (more := NEXT_LINE.match(text, end)):
            width = len(parts[1]) if len(parts) > 1 else max(len(parts[0]), len(more[1]))
            if len(parts) > 1 and len(parts[-1]) < width or len(more[1]) > width:
                break
            parts.append(more[1])
            end = more.end()
        last = end
        yield start, end, "".join(parts)


def _inside(start: int, end: int, run: str, text: str) -> Iterator[tuple[int, int, str]]:
    """What a run may hold besides itself: the lines of one that goes over several, and what begins after a
    border in it. Decoding from places a multiple of four apart gives the same bytes, so there is
    one run for each remainder: from the first border at it on."""
    if len(run) < end - start:
        for m in BASE64.finditer(text, start, end):
            yield m.start(), m.end(), m[0]
    seen = {0}
    for m in BORDER.finditer(run):
        at = m.end()
        if at % 4 not in seen and len(run) - at >= LEAST_RUN:
            seen.add(at % 4)
            whole = len(run) == end - start
            yield start + at if whole else start, end, run[at:]
            if len(seen) == 4:
                break


def _packed_inside(run: str, raw: bytes) -> Iterator[bytes]:
    """What begins like packed data right after a border further on in a run."""
    for m in BORDER.finditer(run):
        at = m.end()
        if at % 4 == 0 and _is_packed(raw[at // 4 * 3 : at // 4 * 3 + 2]):
            yield raw[at // 4 * 3 :]


def _held(raw: bytes) -> bytes:
    """A run's bytes, or what it holds packed if that is one window."""
    if not _is_packed(raw):
        return raw
    windows = (w for stream, _ in _unpacked(_cut(raw), "") for w in _windows(stream))
    return raw if (first := next(windows, None)) is None or next(windows, None) is not None else first


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers right below one, made one at a time."""
    here = layer.text
    if "%" in here and (pieces := _percent(here)):
        yield layer.replaced(pieces, "url")
    if ("\\" in here or "&#" in here) and (pieces := _escaped(here)):
        yield layer.replaced(pieces, "unicode")
    clear, all_ = [], []
    for start, end, run in _base64(here):
        raw = _decoded(run)
        for first, last, part in chain([(start, end, run)], _inside(start, end, run, here)):
            marks, bytes_ = [(0, *layer.span(first, last), False)], raw if part is run else _decoded(part)
            for data in chain([bytes_], _packed_inside(part, bytes_)):
                for stream, path in _unpacked(_cut(data), "base64"):
                    for window in _windows(stream):
                        for decoded in _texts(window):
                            yield Layer(decoded, marks, f"{layer.path}{path}>")
        raw = _held(raw)
        if decoded := _lossless(raw):
            clear.append((start, end, decoded))
        all_.append((start, end, decoded or raw.decode(errors="replace")))
    # what stands around a run may name the secret in it; words that only look like base64 stay
    if clear:
        yield layer.replaced(clear, "base64")
    if len(clear) < len(all_):
        yield layer.replaced(all_, "base64")


def _mark(text: str) -> str | bytes:
    """The text, or of a long one a digest, so that windows aren't kept."""
    return text if len(text) < PACKED else hashlib.sha256(text.encode(errors="surrogatepass")).digest()


def find_secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    """All spans as (start, number of the kind, end, path of layers), sorted; the base ones,
    which have the path '', come first among equals. A span found again in a deeper layer
    counts once."""
    if not text:
        return []
    found = {span: "" for span in scan(text)}
    seen = {_mark(text)}
    work = [_inner(Layer(text, [(0, 0, len(text), True)], ""))]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
        elif layer.text and (mark := _mark(layer.text)) not in seen:
            seen.add(mark)
            for start, kind, end in scan(layer.text):
                first, last = layer.span(start, end)
                found.setdefault((first, kind, last), layer.path)
            work.append(_inner(layer))
    return sorted((start, kind, end, path) for (start, kind, end), path in found.items())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (kind, start, end, path):
    code points of the text, end exclusive; ``path`` names the layers, '' for the text itself."""

    def rows(batches):
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                spans = find_secrets(text)
                yield key, [{"kind": KINDS[k], "start": s, "end": e, "path": p} for s, k, e, p in spans]

    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])
    return map_rows(
        pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long")),
        f"{id_col} long, spans array<struct<kind: string, start: long, end: long, path: string>>",
        pa.schema([(id_col, pa.int64()), ("spans", pa.list_(one))]),
        rows,
        lambda row: 64 + 96 * len(row[1]),
    )
