"""Batches of JSON records, in files or in ZIP archives, with positions and rejects."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.operators.ingest import RECORD, validated

_FOUND = "source string, member string, position int, record string, problem string"
#: Largest member of an archive that is read.
MOST_BYTES = 512 * 1024 * 1024


#: Bytes read at a time.
CHUNK = 1 << 16
_STRUCTURE = re.compile(r'["\\\[\]{},]')


def stream_items(chunks: Iterable[str]) -> Iterator[str]:
    """The items of a JSON array as they stand, from pieces of its text; one item is held at a time, and none is parsed.

    A text that isn't one array, or ends before it does, is a ``ValueError`` when that shows.
    """
    held, at, begin = "", 0, 0
    depth, quoted, done = 0, False, False
    skip = False  # the character after a backslash
    for chunk in chunks:
        held += chunk
        while True:
            if skip:
                if at >= len(held):
                    break
                at, skip = at + 1, False
            m = _STRUCTURE.search(held, at)
            if not depth and held[at : m.start() if m else len(held)].strip():
                raise ValueError("text outside of the array")
            if m is None:
                at = len(held)
                break
            c, at = m[0], m.end()
            if quoted:
                skip = c == "\\"
                quoted = c != '"'
            elif c == '"' and depth:
                quoted = True
            elif c in "[{" and not done and (depth or c == "["):
                depth += 1
                if depth == 1:
                    begin = at
            elif c in "]}" and depth:
                depth -= 1
                if depth == 0:
                    done = True
                    if c != "]":
                        raise ValueError("the array isn't closed by its bracket")
                    if item := held[begin : at - 1].strip():
                        yield item
            elif c == "," and depth == 1:
                yield held[begin : at - 1].strip()
                begin = at
            elif not depth or c != ",":
                raise ValueError("text outside of the array")
        cut = begin if depth else at
        held, at, begin = held[cut:], at - cut, 0
    if not done:
        raise ValueError("the array isn't closed")


def array_items(text: str) -> Iterator[str]:
    """``stream_items`` of a whole text."""
    return stream_items([text])


def _texts(stream) -> Iterator[str]:
    """The text of a UTF-8 stream, piece by piece, without a byte order mark."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    while piece := stream.read(CHUNK):
        yield decoder.decode(piece)
    yield decoder.decode(b"", True)


def _members(name: str, content: bytes) -> Iterator[tuple[str, IO[bytes] | None, str | None]]:
    """(member, stream, problem) of a file, or of an archive's members in order of their names; a member is unpacked as it is read."""
    if not name.endswith(".zip"):
        yield "", io.BytesIO(content), None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if info.is_dir():
                    continue
                if info.file_size > MOST_BYTES:
                    yield info.filename, None, "too_large"
                else:
                    with z.open(info) as stream:
                        yield info.filename, stream, None
    except zipfile.BadZipFile:
        yield "", None, "unreadable"


def _explode(numbers: frozenset[str] | None):
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    runs = re.compile(r"\d+")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw = content.as_py()
                if numbers is not None and not path.endswith(".zip") and numbers.isdisjoint(x.decode() for x in re.findall(rb"\d+", raw)):
                    continue  # the bytes hold none of the numbers: nothing is read as text
                for member, stream, problem in _members(path, raw):
                    rows: list[tuple] = []
                    if problem is None:
                        try:
                            for k, item in enumerate(stream_items(_texts(stream))):
                                if numbers is None or not numbers.isdisjoint(runs.findall(item)):
                                    rows.append((path, member, k, item, None))
                                    if len(rows) >= 1000:
                                        yield batch(rows)
                                        rows = []
                        except (ValueError, UnicodeDecodeError, zipfile.BadZipFile, zlib.error):
                            problem = "unreadable"
                    if problem:
                        rows.append((path, member, None, None, problem))
                    if rows:
                        yield batch(rows)

    return run


def read_batches(spark: SparkSession, path: str, numbers: Iterable[str] | None = None) -> DataFrame:
    """``source, member, position, record, problem``: the records of JSON arrays in files or archives.

    Records are cut out of the stream one at a time. With ``numbers`` (a list of a query's digits) a file
    is skipped by its bytes unless it holds one of them, and so is a record, before anything is parsed.
    A file or member that can't be read to its end has one row with its problem, beside the records before
    it, so that an absence is never concluded from an incomplete read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(_explode(None if numbers is None else frozenset(numbers)), _FOUND)


def parsed(batches: DataFrame, court: str = "STJ") -> DataFrame:
    """Records of ``read_batches`` parsed and validated; ``reason`` says what is wrong with one."""
    rows = batches.where("record is not null").select("source", "member", "position", F.from_json("record", RECORD).alias("r")).select("source", "member", "position", "r.*")
    return validated(rows, court)


def wanted(records: DataFrame, numbers: DataFrame) -> DataFrame:
    """Records whose number is among those wanted (``number``), the last member winning; ``conflict``: it was said differently before."""
    key = F.regexp_replace("numeroProcesso", r"[^0-9]", "")
    rows = records.withColumn("number", key).join(numbers.select("number").distinct(), "number", "left_semi")
    return rows.groupBy("document_id").agg(
        F.max_by(F.struct("source", "member", "position", "hash", "raw"), F.struct("source", "member", "position")).alias("w"), (F.count_distinct("hash") > 1).alias("conflict")
    ).select("document_id", "w.*", "conflict")
