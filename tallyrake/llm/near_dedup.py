"""MinHash near-dedup with odd sketches.

Texts are lower-cased (A-Z), split at 0x20 and 0x09-0x0D, and turned into the set of their
distinct 5-word shingles (64-bit hashes; fewer words: the whole sequence as one; no words: the
empty set, linked with nothing).  Two documents are linked where
``100 * |intersection| >= percent * |union|``.

1. Each set gets ``BINS`` = 640 MinHash samples by one permutation with filled-up empty bins,
   from one pass over its hashes.  80 bands of 8 samples make the bucket keys: a pair at
   similarity 0.85 shares no bucket with a chance of 1e-11, at 0.80 of 4e-7.
2. All samples are folded into an *odd sketch* of 1,024 bits: sample i with value v flips the
   bit hash(i, v).  The population count of the XOR of two sketches estimates the number of
   differing samples; candidates further off than six standard deviations go.  A second odd
   sketch is folded from all shingles: the population count of its XOR never exceeds the number
   of shingles that differ, so it drops pairs without any error, sharply for sets up to about a
   thousand shingles.
3. Equal sets are one document from here on (their smallest id).  Among the documents that
   share a bucket with another, shingles that no other one has are counted (``own``).  They
   count in full against every partner, so similarity is at most m / (m + own_a + own_b) with
   m the smaller number of shared shingles; pairs under the threshold by this bound can't be
   links and are not formed, and documents that reach it with nobody leave.
4. In a first round every member of a bucket is paired with the bucket's most shared document
   only, and takes its most similar such partner; then components are formed, and a second
   round tries the pairs of members of one bucket that are in different components still.  So
   a group of m copies gives about m pairs, and no link between components is left untried.
5. Links are confirmed on the full sets, from the whole texts.

Defined cases: a null id is never linked and its component is null (kept: true); a repeated
row shares the component of its id; rows of one id must be equal.  Only the id and text
columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import components, keyed, staged

SHINGLE = 5
BINS, ROWS = 640, 8
SKETCH_BITS = 1024
U = np.uint64
_BAND = tv.stream(71, BINS // ROWS)
_IN_BAND = tv.stream(73, ROWS) | U(1)
_ODD = tv.stream(79, BINS)
#: Where an empty bin looks for a sample: the same sequence of other bins in every document.
_TRY = (tv.stream(83, BINS * 64).reshape(64, BINS) % U(BINS)).astype(np.int64)


def shingle_set(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if len(hashes) == 0:
        return np.zeros(0, U)
    return np.unique(tv.sequences(hashes, min(n, len(hashes))))


def samples(shingles: np.ndarray) -> np.ndarray:
    """BINS MinHash samples of a non-empty sorted set."""
    mixed = np.sort(tv.mix(shingles))
    where = ((mixed >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    head = np.concatenate([[True], where[1:] != where[:-1]])
    full = np.zeros(BINS, bool)
    full[where[head]] = True
    out = np.zeros(BINS, U)
    out[where[head]] = mixed[head]
    if not full.all():
        todo = np.flatnonzero(~full)
        for step in _TRY:                       # a bin with a sample is met soon, by the same way for all sets
            found = full[step[todo]]
            out[todo[found]] = out[step[todo[found]]]
            todo = todo[~found]
            if not len(todo):
                break
        if len(todo):                           # very few full bins: the nearest one to the right
            right = np.flatnonzero(full)
            out[todo] = out[right[np.searchsorted(right, todo) % len(right)]]
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tv.mix((sample.reshape(-1, ROWS) * _IN_BAND).sum(axis=1, dtype=U) + _BAND)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits as 64-bit words."""
    with np.errstate(over="ignore"):
        at = (tv.mix(sample + _ODD) >> U(64 - (SKETCH_BITS.bit_length() - 1))).astype(np.int64)
    odd = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def whole_sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits of the set itself."""
    at = (tv.mix(shingles ^ U(0x2545F4914F6CDD1D)) >> U(64 - (SKETCH_BITS.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _signatures(batches):
    for batch in batches:
        ids = np.asarray(batch.column(0))
        rows = []
        for w in tv.words(batch.column(1), lower=True):
            for r in range(w.rows):
                s = shingle_set(w.hashes[w.offsets[r]:w.offsets[r + 1]])
                i = int(ids[w.first + r])
                if not len(s):
                    rows.append((i, 0, None, None, None, None, None))
                    continue
                with np.errstate(over="ignore"):
                    d = tv.signed(np.array([tv.mix(s).sum(dtype=U), tv.mix(s ^ U(0x5BD1E9955BD1E995)).sum(dtype=U)]))
                x = samples(s)
                rows.append((i, len(s), int(d[0]), int(d[1]), tv.signed(band_keys(x)), odd_sketch(x), whole_sketch(s)))
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                   pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())))],
            ["id", "n_shingles", "d1", "d2", "bands", "sketch", "whole"])


def _shingle_rows(batches):
    """(hash, id) of every distinct shingle of every document."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for w in tv.words(batch.column(1), lower=True):
            sets = [shingle_set(w.hashes[w.offsets[r]:w.offsets[r + 1]]) for r in range(w.rows)]
            if sets:
                yield pa.RecordBatch.from_arrays([
                    pa.array(tv.signed(np.concatenate(sets))),
                    pa.array(np.repeat(ids[w.first:w.first + w.rows], [len(x) for x in sets]))], ["h", "id"])


def _count_common(batches):
    """Exact intersection and union of the shingle sets of two texts per row."""
    for batch in batches:
        sets = []
        for c in (2, 3):
            mine = []
            for w in tv.words(batch.column(c), lower=True):
                mine += [shingle_set(w.hashes[w.offsets[r]:w.offsets[r + 1]]) for r in range(w.rows)]
            sets.append(mine)
        both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)], np.int64)
        total = np.array([len(a) + len(b) for a, b in zip(*sets)], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(total - both)],
                                         ["a", "b", "common", "joint"])


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches are not clearly too far apart."""
    t = percent / 100.0
    side = lambda k: sketches.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    off = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    mean = SKETCH_BITS / 2 * (1 - math.exp(-4.0 * BINS * (1 - t) / SKETCH_BITS))
    # samples of small sets repeat each other: their spread follows the smaller of set size and samples
    slope = 2 * BINS * math.exp(-4.0 * BINS * (1 - t) / SKETCH_BITS) * math.sqrt(t * (1 - t))
    eff = F.least(F.lit(BINS), F.greatest("na", "nb"))
    most = mean + 6 * F.sqrt(slope ** 2 / eff + SKETCH_BITS / 4)
    return near.withColumn("off", off).filter(F.col("off") <= most).select("a", "b", "off")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    with_a = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("body").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("body").alias("tb")), "b")
    counted = both.select("a", "b", "ta", "tb").mapInArrow(_count_common, "a long, b long, common long, joint long")
    return counted.select("a", "b", (100 * F.col("common") >= percent * F.col("joint")).alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row of ``docs``."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    known = src.filter("id is not null")
    sig = staged(known.mapInArrow(_signatures, "id long, n_shingles long, d1 long, d2 long, "
                                               "bands array<long>, sketch array<long>, whole array<long>"), "near-sig")
    # a table of its own: the join's shuffles are then plain ones and Spark may split a hot set
    sets = staged(sig.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep")), "near-sets")
    member = staged(sig.select("id", "n_shingles", "d1", "d2").join(sets, ["d1", "d2"], "left")
                    .select("id", "n_shingles", "rep"), "near-member")
    reps = member.filter("id = rep").select("id").distinct()
    sketches = sig.join(reps, "id", "left_semi").select("id", F.col("n_shingles").alias("n"), "sketch", "whole", "bands")

    keyed = sketches.select("id", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    shared = staged(keyed.join(full.select("key"), "key", "left_semi").distinct(), "near-shared")
    active = shared.select("id").distinct()
    texts = staged(known.join(active, "id", "left_semi").dropDuplicates(["id"]), "near-texts")
    own = (texts.mapInArrow(_shingle_rows, "h long, id long").groupBy("h")
           .agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("own")))
    sketches = staged(sketches.select("id", "n", "sketch", "whole").dropDuplicates(["id"]).join(active, "id", "left_semi")
                      .join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
                      .filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "near-sketches")
    buckets = shared.join(sketches.select("id", "n", "own"), "id")

    # round 1: a member and the most shared document of one of its buckets, the most similar one
    centre = buckets.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("r"), "id", "n", "own")).alias("c"),
                                        F.count("*").alias("k")).filter("k > 1").select("key", "c")
    buckets = staged(buckets.join(centre, "key").select("key", "id", "n", "own", F.col("c.id").alias("cid"),
                                                        F.col("c.n").alias("cn"), F.col("c.own").alias("cown")), "near-buckets")

    def within(n1, own1, n2, own2):
        most = F.least(F.col(n1) - F.col(own1), F.col(n2) - F.col(own2))
        return 100 * most >= percent * (most + F.col(own1) + F.col(own2))

    star = buckets.filter((F.col("cid") != F.col("id")) & within("n", "own", "cn", "cown")).select(
        F.least("cid", "id").alias("a"), F.greatest("cid", "id").alias("b"), "id").distinct()
    near = _plausible(star.select("a", "b").distinct(), sketches, percent)
    best = (star.join(near, ["a", "b"]).groupBy("id").agg(F.min(F.struct("off", "a", "b")).alias("at"))
            .select("at.a", "at.b").distinct())
    tried = staged(_confirmed(best, texts, percent), "near-tried")
    edges = tried.filter("linked").select("a", "b")
    comp = components(edges)

    # round 2: pairs of one bucket that are in different components
    placed = buckets.join(comp.withColumnRenamed("v", "id"), "id", "left").select(
        "key", "id", "n", "own", F.coalesce("comp", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("key")
    words = [F.col("whole")[i].alias(f"s{i}") for i in range(SKETCH_BITS // 64)]
    open_ = staged(placed.join(mixed, "key", "left_semi").join(sketches.select("id", *words), "id"), "near-open")
    names = ("id", "n", "own", "comp", *[f"s{i}" for i in range(SKETCH_BITS // 64)])
    left, right = (open_.select("key", *[F.col(c).alias(c + side) for c in names]) for side in "ab")
    differ = sum((F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(1, SKETCH_BITS // 64)),
                 F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))))
    # sketches are compared inside the join: only pairs that may be links are made
    more = (left.join(right, (left["key"] == right["key"]) & (F.col("ida") < F.col("idb")) & (F.col("compa") != F.col("compb"))
                      & within("na", "owna", "nb", "ownb")
                      & ((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))))
            .select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()
            .join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    likely = staged(_plausible(more, sketches, percent), "near-likely")
    extra = staged(_confirmed(likely, texts, percent).filter("linked").select("a", "b"), "near-extra")
    if not extra.isEmpty():
        comp = components(edges.union(extra))
    out = member.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select(
        "id", "n_shingles", F.coalesce("comp", "rep", "id").alias("component_id"))
    nameless = src.filter("id is null").mapInArrow(_sizes, "n_shingles long").select(
        F.lit(None).cast("long").alias("id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _sizes(batches):
    for batch in batches:
        n = []
        for w in tv.words(batch.column(1), lower=True):
            n += [len(shingle_set(w.hashes[w.offsets[r]:w.offsets[r + 1]])) for r in range(w.rows)]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_shingles"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their near-duplicate group.

    Rows of one id are one document, of which one row stays; rows without an id take part like
    others, but a row with an id stays before them."""
    rows = keyed(docs, id_col, text_col)
    gone = near_duplicates(rows, "id", "text", percent).filter("not kept").select("id").distinct()
    kept = rows.select("row", "id").join(gone, "id", "left_anti")
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id"])
    return kept.select("row.*")
