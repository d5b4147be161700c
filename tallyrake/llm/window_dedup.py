"""Substring dedup of repeated word windows with a count-min prefilter.

A window is ``WINDOW`` = 13 consecutive words; words are the runs of bytes other than 0x20
and 0x09-0x0D, unchanged.  Each word covered by a window whose words also start in a document
with a smaller id is removed (windows are judged on the input).

1. *Sketch*: every window is represented by its key, the smallest hash of its seven 7-word
   parts (neighbouring windows share keys, so about a quarter as many keys as windows are
   counted).  Equal windows have equal keys, so a key's count is an upper bound of the counts
   of its windows.  The count-min sketch has ``ROWS`` rows; each task emits its cells in blocks
   of 65,536, Spark merges the blocks, and a cell keeps one bit: counted at least twice.  A
   window is suspected if all its cells are set.  The bits are sent to all tasks; their number
   follows the corpus up to ``max_cells`` bits, a documented bound of what a task holds.  A
   fuller sketch lets more windows through to the exact pass and loses none.
2. *Exact pass*: suspected windows are sorted and merged within each task to (64-bit hash, 32-bit
   check, smallest id, largest id) and sent as packed blocks to buckets of the hash space, whose
   number follows the corpus; above 2^12 the blocks are dealt in several rounds.  A window with
   two different ids keeps its smallest id.
3. Occurrences are joined back by hash and check (a join that Spark may split); those in later
   documents give the words to drop.  Documents without any are left where they lie: a bit table
   of the ids with hits (at most ``ID_BITS`` bits) tells most of them, so their texts are not shuffled.

Defined cases: null, empty and blank texts have no words; texts under 13 words keep all; very
long texts are hashed whole in one task; a repeated row has an equal id, so it removes nothing
from its twin; rows of one id with different texts count as one document, each losing the words
under its own windows that a smaller id has; a row with a null id takes no part and keeps all; an
empty table gives no rows.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .bittable import bit_table, marked
from .common import release, staged

WINDOW = 13
PART = 7
BLOCK = 1 << 16
MAX_CELLS = 1 << 28
ROWS = 4
ID_BITS = 1 << 24
FLUSH = 1 << 19                   # windows a task collects before it sorts and sends them
BUCKET_BYTES = 1 << 22            # text per bucket of the hash space
FAN_BITS = 12
U = np.uint64


def windows_of(w: tv.Words, window: int, part: int):
    """(start word, key, window hash or None) of all windows of a run of rows."""
    keys = tv.sliding_min(tv.sequences(w.hashes, part), window - part + 1)
    ok = tv.valid_starts(w.offsets, window, len(w.hashes))
    at = np.flatnonzero(ok)
    return at, keys[:len(ok)][at] if len(at) else np.zeros(0, U)


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """Cell per sketch row (ROWS x keys); every row has cells / ROWS cells of its own."""
    row = cells // ROWS
    shift = U(64 - (row.bit_length() - 1))
    return np.stack([((keys if r == 0 else tv.mix(keys + U(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) >> shift).astype(np.int64)
                     + r * row for r in range(ROWS)])


def _cells(window: int, part: int, cells: int):
    def run(batches):
        for batch in batches:
            got = []
            for w in tv.words(batch.column(0), lower=False):
                at, keys = windows_of(w, window, part)
                if len(at):
                    row = np.searchsorted(w.offsets, at, "right")
                    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])
                    got.append(keys[new])
            if not got:
                continue
            for of_row in cells_of(np.concatenate(got), cells):
                all_cells = np.sort(of_row)
                third = np.zeros(len(all_cells), bool)      # a count of two says all there is to say
                third[2:] = (all_cells[2:] == all_cells[1:-1]) & (all_cells[2:] == all_cells[:-2])
                all_cells = all_cells[~third]
                block = all_cells // BLOCK
                cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                low = (all_cells % BLOCK).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block[cut].astype(np.int32)),
                    pa.array([low[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(low)))], pa.binary())],
                    ["block", "cells"])
    return run


def _merge(batches):
    """Merged bit blocks; rows come sorted by block, so one counter array is held at a time."""
    now, count = None, np.zeros(BLOCK, np.uint8)

    def out():
        bits = np.packbits(count >= 2, bitorder="little")
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
                                          ["block", "bits"])
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != now:
                if now is not None and (count >= 2).any():
                    yield out()
                now, count = block, np.zeros(BLOCK, np.uint8)
            low = np.frombuffer(cells, np.uint16)
            two = np.zeros(BLOCK, np.uint8)
            two[low] = 1
            two[low[1:][low[1:] == low[:-1]]] = 2
            count = np.minimum(count + two, 2)
    if now is not None and (count >= 2).any():
        yield out()


def repeated_cells(body: DataFrame, window: int, part: int, cells: int) -> np.ndarray:
    """One bit per cell, merged from the sketches of all partitions (at most cells / 8 bytes)."""
    parts = body.select("body").mapInArrow(_cells(window, part, cells), "block int, cells binary")
    merged = (parts.repartition("block").sortWithinPartitions("block")
              .mapInArrow(_merge, "block int, bits binary"))
    bits = np.zeros(max(1, cells // BLOCK) * (BLOCK // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row["block"] * (BLOCK // 8):(row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _suspected(batches, window: int, part: int, cells: int, sketch, marks: bool = False):
    """(hashes, checks, row's id, word position, row's mark) of the suspected windows of each run of rows."""
    bits = sketch.value
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for w in tv.words(batch.column(1), lower=False):
            at, keys = windows_of(w, window, part)
            for cell in cells_of(keys, cells) if len(at) else ():
                at = np.where((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1, at, -1)
            at = at[at >= 0]
            if len(at):
                row = np.searchsorted(w.offsets, at, "right") - 1
                check = (tv.sequences(tv.mix(w.hashes ^ U(0x5851F42D4C957F2D)), window)[at] >> U(32)).astype(np.uint32)
                yield (tv.sequences(w.hashes, window)[at], check, ids[w.first + row], at - w.offsets[row],
                       np.asarray(batch.column(2)).astype(U)[w.first + row] if marks else None)


KINDS = (np.uint64, np.uint32, np.int64, np.int64)         # hash, check, smallest id, largest id
BLOCK_SCHEMA = "bucket long, block binary"


def merged(parts: list):
    """Windows sorted by (hash, check), equal ones merged."""
    h, check, low, high = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(h)
    if ((h[order][1:] == h[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
    h, check = h[order], check[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
    return h[new], check[new], np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new)


def _blocks(parts: list, bits: int):
    buckets, blocks = tv.packed_blocks(merged(parts), bits)
    return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(blocks, pa.binary())], ["bucket", "block"])


def _collected(entries, bits: int):
    parts, held = [], 0
    for e in entries:
        parts.append(e)
        held += len(e[0])
        if held >= FLUSH:
            yield _blocks(parts, bits)
            parts, held = [], 0
    if parts:
        yield _blocks(parts, bits)


def _emit(window: int, part: int, cells: int, sketch, bits: int):
    return lambda batches: _collected(
        ((h, c, i, i) for h, c, i, *_ in _suspected(batches, window, part, cells, sketch)), bits)


def _regroup(bits: int):
    """Blocks of a coarse bucket, merged as far as memory goes and dealt to finer buckets."""
    return lambda batches: _collected((tv.unpack(x, KINDS) for b in batches for x in b.column(1).to_pylist()), bits)


def _repeated(batches):
    """Windows with two ids; rows come sorted by bucket, one bucket is held at a time."""
    def out(parts):
        h, check, low, high = merged(parts)
        two = low < high
        return pa.RecordBatch.from_arrays([pa.array(tv.signed(h[two])), pa.array(check[two].astype(np.int64)),
                                           pa.array(low[two])], ["h", "c", "low"])
    now, parts = None, []
    for batch in batches:
        for bucket, block in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and parts:
                yield out(parts)
                parts = []
            now = bucket
            parts.append(tv.unpack(block, KINDS))
    if parts:
        yield out(parts)


def _places(window: int, part: int, cells: int, sketch):
    """16 check bits, 16 bits of the text's hash (rows of one id may differ) and the position share a column."""
    def run(batches):
        for h, check, ids, at, mark in _suspected(batches, window, part, cells, sketch, True):
            packed = (check >> np.uint32(16)).astype(U) << U(48) | mark << U(32) | at.astype(U)
            yield pa.RecordBatch.from_arrays([pa.array(tv.signed(h)), pa.array(ids), pa.array(tv.signed(packed))], ["h", "id", "at"])
    return run


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    part: int = PART, max_cells: int = MAX_CELLS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, mark, places array<int>)``: word positions where a window starts that also starts in a
    document with a smaller id; mark: the first 16 bits of the text's hash."""
    spark = docs.sparkSession
    body = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
            .filter("id is not null").withColumn("mark", F.shiftrightunsigned(F.xxhash64("body"), 48)))
    size = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cells = min(max_cells, max(ROWS * BLOCK, 1 << int(size).bit_length()))     # about 4 cells a key of about 4 bytes
    sketch = spark.sparkContext.broadcast(repeated_cells(body, window, part, cells))
    bits = max(4, (size // bucket_bytes).bit_length())
    rounds = -(-bits // FAN_BITS)
    step = -(-bits // rounds)
    dealt = body.mapInArrow(_emit(window, part, cells, sketch, step), BLOCK_SCHEMA)
    for k in range(2, rounds + 1):
        dealt = dealt.repartition("bucket").mapInArrow(_regroup(min(bits, step * k)), BLOCK_SCHEMA)
    first = staged(dealt.repartition("bucket").sortWithinPartitions("bucket")
                   .mapInArrow(_repeated, "h long, c long, low long"), "window-first")
    release(spark)
    hits = (body.mapInArrow(_places(window, part, cells, sketch), "h long, id long, at long")
            .join(first, "h")
            .filter((F.col("id") > F.col("low")) & (F.shiftrightunsigned("at", 48) == F.shiftright("c", 16)))
            .select("id", F.shiftrightunsigned("at", 32).bitwiseAND(0xFFFF).alias("mark"),
                    F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("at")))
    out = staged(hits.groupBy("id", "mark").agg(F.collect_list("at").alias("places")), "window-places")
    sketch.unpersist()
    return out


def _with_hits(batch, table) -> np.ndarray:
    return np.asarray(batch.column(0).is_valid()) & marked(np.asarray(batch.column(3)).view(U), table.value)


def _only(table):
    """Rows whose document may have hits."""
    return lambda batches: (batch.select([0, 1, 2]).filter(pa.array(_with_hits(batch, table))) for batch in batches)


def _apply(window: int, without=None):
    """Drops the words under each row's places (column 3); with a table, keeps whole the rows outside it."""
    def run(batches):
        for batch in batches:
            if without is not None:
                batch = batch.filter(pa.array(~_with_hits(batch, without)))
            out = []
            for i, text_hash, body, places in zip(*(batch.column(c).to_pylist() for c in range(4))):
                ws = (body or b"").split()
                total = len(ws)
                if places and without is None:
                    edge = np.zeros(total + 1, np.int64)
                    at = np.unique(np.asarray(places))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    ws = [x for x, g in zip(ws, gone.tolist()) if not g]
                kept = b" ".join(ws)
                out.append((i, text_hash, total, total - len(ws), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                ["id", "text_hash", "n_words", "n_removed", "kept", "kept_sha256"])
    return run


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                  part: int = PART, max_cells: int = MAX_CELLS, only_hits: bool = False) -> DataFrame:
    """``(id, text_hash, n_words, n_removed, kept binary, kept_sha256)`` per row; kept: words joined
    by one space, text_hash: xxhash64 of the text's bytes.  ``only_hits`` gives rows that lose words."""
    places = repeated_places(docs, id_col, text_col, window, part, max_cells)
    spark = docs.sparkSession
    release(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    src = src.select("id", F.xxhash64("body").alias("text_hash"), "body", F.xxhash64("id").alias("key"))
    table = spark.sparkContext.broadcast(bit_table(places.select(F.xxhash64("id").alias("fp")), ID_BITS))
    schema = "id long, text_hash long, n_words long, n_removed long, kept binary, kept_sha256 string"
    cut = (src.mapInArrow(_only(table), "id long, text_hash long, body binary")
           .withColumn("mark", F.shiftrightunsigned("text_hash", 48)).join(places, ["id", "mark"], "left")
           .select("id", "text_hash", "body", "places").mapInArrow(_apply(window), schema))
    return cut.filter("n_removed > 0") if only_hits else src.mapInArrow(_apply(window, table), schema).union(cut)
