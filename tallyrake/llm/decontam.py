"""Benchmark decontamination by spaced-seed hashing.

A *mask* is a fixed pattern of used and ignored token positions.  Hashing only the used ones
lets two texts agree although some tokens between them were replaced.

1. Tokens are runs of letters and digits, lower-cased; in scripts written without spaces every
   character is a token.  Every position of every
   benchmark item and of every document gives one hash per mask.  Items under 12 tokens have
   masks of their own, which documents are hashed by only if there are such items.
2. The benchmark's hashes are merged by Spark into a bit filter of fixed size (2 bits a hash),
   which the tasks use to pass over positions that match nothing; what is left is joined with
   the benchmark's hashes by Spark.  A full filter lets more through and loses none.
3. A hit fixes how item and document lie on each other.  Around it the aligned tokens are
   compared, and the document is contaminated if some ``WINDOW`` = 16 aligned tokens have at
   least 13 equal ones (an item under 16 tokens: all of it, with at least 80 % and 6 equal; an
   item under 6 tokens: all of it, with all equal).

Items under ``least_tokens`` tokens (a parameter) are left out and told by ``too_short``.

Defined cases: null or empty texts and items match nothing; repeated items and rows give the same
results once per id, rows of one id count together; ``contaminated`` tells documents without an id
as one null id, ``drop_contaminated`` tells them apart by their texts; very long texts are hashed
whole in one task; of tied overlaps the counts are told once; empty tables give no rows.  The result
has one row per contaminated (document, item), with the best overlap.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import keyed

#: Used token positions of the masks (spans 6 to 13), and of those for items under LONG tokens:
#: some mask fits at whatever tokens the tolerance lets differ (the tests try all ways).
LONG_MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 3, 6, 8, 9), (0, 1, 4, 6, 9, 10), (0, 3, 5, 6, 10, 12))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
#: Items under LEAST tokens are matched as they are, by the mask of their length.
LEAST = 6
EXACT_MASKS = tuple(tuple(range(n)) for n in range(1, LEAST))
MASKS = LONG_MASKS + SHORT_MASKS + EXACT_MASKS
EXACT_AT = len(LONG_MASKS) + len(SHORT_MASKS)
LONG = 12
WINDOW, EQUAL = 16, 13
SHORT_SHARE = 0.8
#: Items under this many tokens are left out (``too_short`` tells them): a one-word answer is in every text.
LEAST_TOKENS = 5
FILTER_BITS = 1 << 27
U = np.uint64
_TOKEN = re.compile(r"[^\W_]+")
#: Letters and signs of Thai, Lao, Burmese, Khmer, kana, bopomofo, Yi and Chinese characters.
_UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u109d\uaa60-\uaa7f\u1780-\u17d3\u17d7\u17dc"
             "\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff"
             "\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_ONE = re.compile(f"[{_UNSPACED}]")
_MIXED = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_SALT = tv.stream(97, len(MASKS))


class _Hashes(dict):
    """Hashes of the tokens met so far."""

    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace"))
        return h


_KNOWN = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's tokens."""
    if len(_KNOWN) > 1 << 18:
        _KNOWN.clear()
    if not text:
        return np.array([], U)
    text = text.lower()
    pattern = _TOKEN if text.isascii() or not _ONE.search(text) else _MIXED
    return np.array(list(map(_KNOWN.__getitem__, pattern.findall(text))), U)


def item_masks(n: int) -> range:
    """The masks of an item of n tokens."""
    if n < LEAST:
        return range(EXACT_AT + n - 1, EXACT_AT + n)
    return range(len(LONG_MASKS)) if n >= LONG else range(len(LONG_MASKS), EXACT_AT)


def seeds(t: np.ndarray, masks=range(len(MASKS))):
    """(mask, hashes) of all positions where the mask fits."""
    with np.errstate(over="ignore"):
        for k in masks:
            mask = MASKS[k]
            m = len(t) - mask[-1]
            if m > 0:
                h = np.full(m, _SALT[k], U)
                for j, at in enumerate(mask):
                    h = h + t[at:at + m] * tv.POSITION[j]
                yield k, tv.mix(h)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U(FILTER_BITS - 1)).astype(np.int64), (h >> U(32) & U(FILTER_BITS - 1)).astype(np.int64)


def overlap(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int] | None:
    """(equal, compared) of the best verified window where item token i lies on document token
    i + shift; None if no window verifies."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b <= a:
        return None
    same = item[a:b] == doc[a + shift:b + shift]
    if len(item) < WINDOW:
        got = int(same.sum())
        return (got, len(item)) if got >= min(LEAST, len(item)) and got >= SHORT_SHARE * len(item) else None
    if len(same) < WINDOW:
        return None
    run = np.convolve(same, np.ones(WINDOW, int), "valid")
    return (int(run.max()), WINDOW) if run.max() >= EQUAL else None


def _item_rows(least: int):
    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = tokens(text)
                if len(t) >= max(1, least):
                    for k, h in seeds(t, item_masks(len(t))):
                        rows += [(int(x), item, p, k) for p, x in enumerate(tv.signed(h))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "item", "at", "mask"])
    return run


def too_short(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``(item, tokens)`` of the items that are left out for having too few tokens."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    return items.mapInArrow(_item_tokens, "item long, tokens array<long>").select(
        "item", F.size("tokens").alias("tokens")).filter(F.col("tokens") < least_tokens)


def _item_tokens(batches):
    for batch in batches:
        got = [tv.signed(tokens(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], ["item", "tokens"])


def seed_filter(rows: DataFrame) -> np.ndarray:
    """Bits of all benchmark hashes; at most FILTER_BITS / 8 bytes reach the driver."""
    low = F.col("h").bitwiseAND(FILTER_BITS - 1)
    high = F.shiftrightunsigned("h", 32).bitwiseAND(FILTER_BITS - 1)
    words = (rows.select(F.explode(F.array(low, high)).alias("b"))
             .groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toArrow()
    bits[got["w"].to_numpy()] = got["v"].to_numpy()
    return bits.view(np.uint8)


def _hits(sent, masks):
    def run(batches):
        bits = sent.value
        try:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    t = tokens(text.as_py())
                    for k, h in seeds(t, masks):
                        a, b = _bits(h)
                        at = np.flatnonzero((bits[a >> 3] >> (a & 7)) & 1)
                        at = at[(bits[b[at] >> 3] >> (b[at] & 7)) & 1 == 1]
                        if k >= EXACT_AT:                   # one place says as much as all
                            at = at[np.unique(h[at], return_index=True)[1]]
                        for p in at.tolist():   # the tokens around the hit go along: no text is moved
                            lo = max(0, p - WINDOW)
                            rows.append((int(tv.signed(h[p:p + 1])[0]), doc, p, lo, tv.signed(t[lo:p + WINDOW])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (
                    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())))],
                    ["h", "doc", "p", "lo", "near"])
        finally:
            _KNOWN.clear()                       # the process stays and serves other tasks
    return run


def _verify(batches):
    for batch in batches:
        keep, equal, size, at = [], [], [], []
        cols = [batch.column(c) for c in range(batch.num_columns)]
        for k in range(batch.num_rows):
            item = np.array(cols[5][k].as_py(), np.int64)
            near = np.array(cols[4][k].as_py(), np.int64)
            shift = cols[2][k].as_py() - cols[3][k].as_py()
            got = overlap(item, near, shift)
            if got:
                keep.append(k)
                equal.append(got[0])
                size.append(got[1])
                at.append(shift)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([cols[0].take(take), cols[1].take(take), pa.array(equal, pa.int32()),
                                          pa.array(size, pa.int32())], ["doc", "item", "n_equal", "n_compared"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``(id, item, n_equal, n_compared)``: one row per document and item that overlap.

    The 16 tokens before a hit and the 16 from it on are compared: every window that begins at
    most 16 tokens before a hit and holds its first token."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    rows = items.mapInArrow(_item_rows(least_tokens), "h long, item long, at int, mask int")
    masks = sorted(rows.select("mask").distinct().toArrow()["mask"].to_pylist())
    sent = spark.sparkContext.broadcast(seed_filter(rows))
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    hits = src.mapInArrow(_hits(sent, masks), "h long, doc long, p int, lo int, near array<long>")
    laid = hits.join(rows, "h").select("doc", "item", (F.col("p") - F.col("at")).alias("shift"), "lo", "near").distinct()
    texts = items.mapInArrow(_item_tokens, "item long, tokens array<long>").dropDuplicates(["item"])
    found = laid.join(texts, "item").select("doc", "item", "shift", "lo", "near", "tokens").mapInArrow(
        _verify, "doc long, item long, n_equal int, n_compared int")
    best = F.max(F.struct("n_equal", "n_compared"))
    return found.groupBy("doc", "item").agg(best.alias("b")).select(F.col("doc").alias("id"), "item", "b.n_equal", "b.n_compared")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item; of rows with one id, all go if one does."""
    rows = keyed(docs, id_col, text_col)
    bad = contaminated(rows, benchmark, "id", "text", least_tokens=least_tokens).select("id").distinct()
    return rows.select("row", "id").join(bad, "id", "left_anti").select("row.*")
