"""Dropped files: plain, zip or tar.gz, as entries of text.

Archives are read entry by entry inside a task. A zip is scanned by its local headers, not by
its directory at the end, so a file that was cut off still yields the entries before the cut.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_NAMES = r"(?i)\.(jsonl|txt|md|log)$"
_LOCAL = b"PK\x03\x04"


def zip_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Stored and deflated entries up to the first that is damaged, cut or of unknown size."""
    at = 0
    while data[at : at + 4] == _LOCAL and len(data) >= at + 30:
        flags, method = struct.unpack_from("<HH", data, at + 6)
        packed, _, name_size, extra = struct.unpack_from("<IIHH", data, at + 18)
        start = at + 30 + name_size + extra
        body = data[start : start + packed]
        if flags & 8 or len(body) < packed:
            return
        name = data[at + 30 : at + 30 + name_size].decode("utf-8", "replace")
        at = start + packed
        if name.endswith("/") or method not in (0, 8):
            continue
        try:
            yield name, zlib.decompress(body, -15) if method else body
        except zlib.error:
            return


def tar_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files, as far as the archive is intact."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as archive:
            for member in archive:
                if member.isreg() and (file := archive.extractfile(member)):
                    yield member.name, file.read()
    except (tarfile.TarError, EOFError, zlib.error, OSError):
        return


def entries(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if data[:2] == b"PK":
        return zip_entries(data)
    if data[:2] == b"\x1f\x8b":
        return tar_entries(data)
    return iter([(name, data)])


def unpack(files: DataFrame) -> DataFrame:
    """``path, entry, format, content`` of the readable entries in files (``path, content``)."""
    schema = pa.schema([("path", pa.string()), ("entry", pa.string()), ("content", pa.string())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):  # one file at a time, whatever a batch holds
                path = path.as_py()
                for name, data in entries(path.rsplit("/", 1)[-1], content.as_py()):
                    yield pa.RecordBatch.from_pylist([{"path": path, "entry": name, "content": data.decode("utf-8", "replace")}], schema)

    out = files.select("path", "content").mapInArrow(run, "path string, entry string, content string")
    return out.where(readable(F.col("entry"))).withColumn("format", F.when(is_session(F.col("content")), "session-jsonl").otherwise("text"))


def read_drops(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """The entries of all files below ``path``, or of those changed since a time; the others aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return unpack(reader.load(path))


def readable(name: Column) -> Column:
    """Names of text files, or names without an extension."""
    return name.rlike(TEXT_NAMES) | ~name.contains(".")


def is_session(content: Column) -> Column:
    """Whether one of the first lines (50 or so, in 64 KiB) is a session's message."""
    lines = F.slice(F.filter(F.split(F.substring(content, 1, 65_536), "\n"), lambda x: F.length(F.trim(x)) > 0), 1, 51)

    def message(line: Column) -> Column:
        has = F.get_json_object(line, "$.message").isNotNull()
        return has & ((F.get_json_object(line, "$.type") == "message") | line.contains('"parentUuid"'))

    return F.coalesce(F.exists(lines, lambda x: F.coalesce(message(x), F.lit(False))), F.lit(False))


def fingerprint(size: Column, modified: Column, content: Column) -> Column:
    """A file's fingerprint: size, time and 64 KiB at both ends."""
    ends = F.concat(content.substr(1, 65_536), content.substr(-65_536, 65_536))
    return F.substring(F.sha2(F.concat(F.concat_ws("|", size.cast("string"), modified.cast("string")).cast("binary"), ends), 256), 1, 16)
