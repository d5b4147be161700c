"""Token-id files of independent zstandard frames with a trailing seek table.

File layout (little-endian), one file per range of document ids, in ascending id order::

    frame*   zstandard frame of the ids (unsigned 32 bit) of some whole documents
             each frame is followed by an empty skippable frame GAP (8 bytes)
    table    skippable frame: zstandard-compressed JSON of the frames
             [offset, packed size, raw size, crc32 of the raw bytes] and of the documents
             [id, frame, place in the frame, ids], all as columns
    footer   skippable frame of 16 bytes: length of the table frame, MAGIC

and one last GAP.  Every frame stands alone, so a reader takes the footer, the table, and then
only the frames of the documents asked for; a frame that fails its checksum is reported.

Spark sorts the documents by id into ranges and each task builds its file's records.  The
files themselves are written by Spark's text writer (its line separator is GAP, a valid empty
zstandard frame), so they go to any Hadoop file system, are committed atomically, and survive
lost executors.  They are read through Spark's binaryFile source.

Defined cases: a null or empty text has only the end id; an empty table makes no documents;
null ids come first; repeated rows are stored one by one; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _batches, codec, read_spec

MAGIC = b"TKSEEK01"
SKIPPABLE, HEAD = 0x184D2A50, 8
GAP = struct.pack("<II", SKIPPABLE, 0)                    # all bytes below 128: valid as a line separator
FRAME_BYTES = 1 << 18
FILE_BYTES = 24 << 20                            # of text; files are read whole, so they stay small
LEVEL = 3


def skippable(data: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE + 1, len(data)) + data


class FileBuilder:
    """Records of one file: frames as they fill, then the seek table and the footer."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.at, self.size = frame_bytes, 0, 0
        self.frames: list[list[int]] = []
        self.docs: list[list] = [[], [], [], []]
        self.open: list[bytes] = []
        self.zip = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id, packed: bytes) -> Iterator[bytes]:
        for column, value in zip(self.docs, (doc_id, len(self.frames), self.size // 4, len(packed) // 4)):
            column.append(value)
        self.open.append(packed)
        self.size += len(packed)
        if self.size >= self.frame_bytes:
            yield self._close()

    def _close(self) -> bytes:
        raw = b"".join(self.open)
        frame = self.zip.compress(raw)
        self.frames.append([self.at, len(frame), len(raw), zlib.crc32(raw)])
        self.at += len(frame) + len(GAP)
        self.open, self.size = [], 0
        return frame

    def end(self) -> Iterator[bytes]:
        if not self.docs[0]:
            return
        if self.open:
            yield self._close()
        table = skippable(self.zip.compress(json.dumps({"frames": self.frames, "docs": self.docs}).encode()))
        yield table + skippable(struct.pack("<Q", len(table)) + MAGIC)


def seek_table(data: bytes) -> dict:
    """The table of a file's bytes; ValueError where the footer is missing or cut."""
    foot = data[-len(GAP) - 16:-len(GAP)]
    if foot[8:] != MAGIC:
        raise ValueError("no seek table at the end of the file")
    size = struct.unpack("<Q", foot[:8])[0]
    end = len(data) - len(GAP) - 16 - HEAD
    return json.loads(zstandard.ZstdDecompressor().decompress(data[end - size + HEAD:end]))


def read_documents(data: bytes, wanted: Iterable[int] | None = None) -> Iterator[tuple]:
    """(id, place in the file, packed ids) of all or of the wanted documents; only their frames
    are decompressed, each once, and held against their checksums."""
    table = seek_table(data)
    unzip = zstandard.ZstdDecompressor()
    ask = None if wanted is None else set(wanted)
    base = np.cumsum([0, *(f[2] // 4 for f in table["frames"])])
    now, raw = None, b""
    for doc, frame, at, n in zip(*table["docs"]):
        if ask is not None and doc not in ask:
            continue
        if frame != now:
            off, packed, size, crc = table["frames"][frame]
            raw = unzip.decompress(data[off:off + packed], max_output_size=size)
            if len(raw) != size or zlib.crc32(raw) != crc:
                raise ValueError(f"frame {frame} fails its checksum")
            now = frame
        yield doc, int(base[frame]) + at, raw[4 * at:4 * (at + n)]


def _records(spec, end_id: int, frame_bytes: int):
    tail = struct.pack("<I", end_id)

    def run(batches):
        c = codec(spec.value)
        build = FileBuilder(frame_bytes)
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in _batches(batch.column(1)):
                out = []
                for packed in c.packed(texts):
                    out += build.add(ids[at], packed + tail)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(list(build.end()), pa.binary())], ["value"])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 0, file_bytes: int = FILE_BYTES, frame_bytes: int = FRAME_BYTES) -> None:
    """Encode every whole text, add ``end_id``, and write the files under ``path``."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    sent = spark.sparkContext.broadcast(read_spec(tokenizer))
    (src.repartitionByRange(int(max(1, -(-size // file_bytes))), "id").sortWithinPartitions("id")
     .mapInArrow(_records(sent, end_id, frame_bytes), "value binary")
     .select(F.col("value").cast("string").alias("value"))          # the bytes as they are
     .write.option("lineSep", GAP.decode("ascii")).text(path))


def _documents(wanted):
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if content.as_py():
                    rows = [(name, i, at, len(p) // 4, zlib.crc32(p), p) for i, at, p in read_documents(content.as_py(), wanted)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (
                            pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                        ["file", "id", "at", "n_tokens", "ids_crc32", "packed"])
    return run


def read_token_files(spark: SparkSession, path: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """``(file, id, at, n_tokens, ids_crc32, packed)`` of all or the wanted documents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    ask = None if wanted is None else sorted(set(wanted))
    return files.mapInArrow(_documents(ask), "file string, id long, at long, n_tokens long, ids_crc32 long, packed binary")


def file_starts(files: DataFrame) -> DataFrame:
    """``(file, base)``: sum of ``total`` over the files before, by part number (Spark does not
    pad or cut numbers from 100000 on, so names do not sort)."""
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` read from the files; ``start`` counts the ids of all
    documents before.  The running sum is over files (one row each), not documents."""
    docs = read_token_files(spark, path).drop("packed")
    base = file_starts(docs.groupBy("file").agg(F.sum("n_tokens").alias("total")))
    return docs.join(base, "file").select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
