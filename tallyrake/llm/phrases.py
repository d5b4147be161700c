"""Phrase collocation mining per language by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words
(runs of bytes other than space and tab).  A phrase is two to ``longest`` neighbouring words of
a piece that occur ``least`` times or more in its language.

1. *Fingerprints*: prefix polynomials (mod 2^64) over the bytes give every word's hash as a
   difference of two prefixes, prefix polynomials over the word hashes every n-gram's.  A
   fingerprint is 64 bits mixed with the language (its lowest bits hold n), a second base gives
   32 check bits.  Tasks sort and sum them and send packed blocks of (fingerprint, check,
   occurrence pointer, count) to buckets of the fingerprint space; a bucket's task merges them
   and keeps those that occur ``least`` times.  Buckets follow the number of words; above 2^12 the
   blocks are dealt in several rounds, so a task never holds more than its bucket.
2. *Levels*: an n-gram occurs no oftener than its parts, so level n sends only n-grams whose two
   (n-1)-grams may be frequent.  Frequent fingerprints are marked in a bit table of at most
   ``filter_bits`` bits (a documented bound of what is sent to the tasks); a fuller table lets
   more n-grams through to the exact count, none is lost.
3. *Text*: an occurrence pointer is (32 bits of the hash of language and text, word position).
   Pointers are joined with the texts, the words at the position are hashed again and must give
   fingerprint and check, so phrases whose fingerprints collide come out apart, each from its
   own text, and texts that share 32 bits are told apart.  Only frequent phrases get a text.
4. *Scores*: the cuts of a phrase are joined with the counts of their parts; exact decimals.
   A phrase inside a longer frequent one with at least ``inside`` percent of its occurrences
   goes (the next longer length decides, as anything longer implies it).

Defined cases: null and empty texts have no words, a null language is ``und``; a repeated row
counts as often as it is there; documents need no id; very long texts are hashed whole in one
task; ties of a cut go to the smaller part, ties of the score to more occurrences, then to the
phrase in byte order; an empty table has no phrases.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .bittable import bit_table, marked
from .common import release, staged

LEAST, LONGEST, TOP, INSIDE = 10, 3, 2000, 50
FILTER_BITS = 1 << 28
TOP_PARTS = 16
FLUSH = 1 << 20                   # entries a task collects before it sorts and sends them
BUCKET_WORDS = 1 << 19            # words per bucket of the fingerprint space
FAN_BITS = 12                     # buckets dealt in one round: 2^12
LENGTH_BITS = 3                   # lowest bits of a fingerprint: its number of words
U = np.uint64

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True
BREAK[0x0A:0x0E] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
_BASES = (0x9DDFEA08EB382D69, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x8A5CD789635D2DFF)   # odd: they have inverses
_TABLES: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n at least."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U)
                         for b in (base, inverse))
        _TABLES[base] = have
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[k] base^k over i <= k < j."""
    out = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, len(values) + 1)[0][:len(values)], out=out[1:])
    return out


def between(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomials of the stretches starts..ends, wherever they begin."""
    with np.errstate(over="ignore"):
        return (p[ends] - p[starts]) * powers(base, len(p))[1][starts]


class Run:
    """Words of whole rows: byte places, row, link to the next word, and prefix polynomials."""

    def __init__(self, first: int, off: np.ndarray, data: np.ndarray):
        n = len(data)
        inside = ~GAP[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = edge[:n].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        self.data = data
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.offsets = np.searchsorted(self.starts, off)
        rows = np.repeat(np.arange(len(off) - 1), np.diff(self.offsets))
        self.row = rows + first
        broken = np.cumsum(BREAK[data])[self.starts] if n else np.zeros(0, np.int64)
        self.link = (rows[1:] == rows[:-1]) & (broken[1:] == broken[:-1])       # a word's own first byte is no break
        values = tv.BYTE_LOWER[data]
        size = (self.ends - self.starts).astype(U)
        with np.errstate(over="ignore"):
            self.sums = tuple(
                prefix(tv.mix(between(prefix(values, byte), self.starts, self.ends, byte) + size * U(seed)), word)
                for byte, word, seed in ((_BASES[0], _BASES[1], 0x9E3779B97F4A7C15), (_BASES[2], _BASES[3], 0xD6E8FEB86659FD93)))

    def grams(self, at: np.ndarray, n: int, lang: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, checks) of the n words from each place; lang: the language hash of every place."""
        fp, check = (tv.mix(between(p, at, at + n, b) ^ tv.mix(lang + U(n)))
                     for p, b in zip(self.sums, (_BASES[1], _BASES[3])))
        fp = fp >> U(64 - bits) << U(64 - bits) if bits < 64 else fp
        low = U((1 << LENGTH_BITS) - 1)
        return (fp & ~low) | U(n), (check >> U(32)).astype(np.uint32)

    def joined(self, n: int) -> np.ndarray:
        """Places from which n words lie in one piece."""
        m = max(0, len(self.starts) - n + 1)
        ok = np.ones(m, bool)
        for j in range(n - 1):
            ok &= self.link[j:j + m]
        return np.flatnonzero(ok)


def language_hashes(column: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """(code per row, languages, hash per language)."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    return (np.asarray(coded.indices), names,
            np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], U))


# -- packed entries -----------------------------------------------------------------------------
KINDS = (np.uint64, np.uint32, np.uint64, np.uint64)       # fingerprint, check, pointer, count


def summed(entries):
    """Entries sorted by (fingerprint, check), equal ones summed with their smallest pointer."""
    fp, check, ptr, count = entries
    order = np.argsort(fp)
    fp, check = fp[order], check[order]
    same = fp[1:] == fp[:-1]
    if (same & (check[1:] != check[:-1])).any():            # a collision: sort by the check as well
        again = np.lexsort((check, fp))
        order, fp, check = order[again], fp[again], check[again]
    new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]))
    return fp[new], check[new], np.minimum.reduceat(ptr[order], new), np.add.reduceat(count[order], new)


def _blocks(parts: list, bits: int):
    """A batch (bucket, block, null, null) of the summed entries, a block per bucket."""
    e = summed([np.concatenate(c) for c in zip(*parts)])
    buckets, blocks = tv.packed_blocks(e, bits)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets), pa.array(blocks, pa.binary()), pa.nulls(len(blocks), pa.string()),
         pa.nulls(len(blocks), pa.int64())], BLOCK)


BLOCK = ["bucket", "block", "lang", "words"]
BLOCK_SCHEMA = "bucket long, block binary, lang string, words long"
FOUND_SCHEMA = "fp long, ck long, ptr long, a long, lang string, words long"


def _count(n: int, sketch, bits: int, fp_bits: int):
    """Entries of all n-grams whose (n-1)-grams are marked; with n = 1 also the words per language."""
    def run(batches):
        parts, held, words = [], 0, {}
        for batch in batches:
            codes, names, hashes = language_hashes(batch.column(0))
            keys = np.asarray(batch.column(1)).astype(U)
            for first, off, data in tv.byte_runs(batch.column(2)):
                r = Run(first, off, data)
                lang = hashes[codes[r.row]] if len(r.row) else np.zeros(0, U)
                at = r.joined(n)
                if n == 1:
                    for c, k in enumerate(np.bincount(codes[r.row], minlength=len(names)) if len(r.row) else ()):
                        words[names[c]] = words.get(names[c], 0) + int(k)
                elif len(at):
                    part = np.arange(len(r.starts) - n + 2)
                    ok = marked(r.grams(part, n - 1, lang[part], fp_bits)[0], sketch.value)
                    at = at[ok[at] & ok[at + 1]]
                if not len(at):
                    continue
                fp, check = r.grams(at, n, lang[at], fp_bits)
                ptr = (keys[r.row[at]] << U(32)) | (at - r.offsets[r.row[at] - first]).astype(U)
                parts.append((fp, check, ptr, np.ones(len(at), U)))
                held += len(at)
                if held >= FLUSH:
                    yield _blocks(parts, bits)
                    parts, held = [], 0
        if parts:
            yield _blocks(parts, bits)
        if words:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - int(h % U(1 << 20)) for h in language_hashes(pa.array(list(words)))[2]], pa.int64()),
                 pa.nulls(len(words), pa.binary()), pa.array(list(words), pa.string()),
                 pa.array(list(words.values()), pa.int64())], BLOCK)
    return run


def _regroup(bits: int):
    """Blocks of a coarse bucket, summed as far as memory goes and dealt to finer buckets."""
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for bucket, block, lang, words in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                        (bucket, pa.int64()), (None, pa.binary()), (lang, pa.string()), (words, pa.int64()))], BLOCK)
                    continue
                parts.append(tv.unpack(block, KINDS))
                held += len(parts[-1][0])
                if held >= FLUSH:
                    yield _blocks(parts, bits)
                    parts, held = [], 0
        if parts:
            yield _blocks(parts, bits)
    return run


def _merge(least: int):
    """Frequent entries of each bucket; rows come sorted by bucket, one bucket is held at a time."""
    def found(parts):
        e = summed([np.concatenate(c) for c in zip(*parts)])
        keep = e[3] >= U(least)
        k = int(keep.sum())
        fp, check, ptr, count = (c[keep] for c in e)
        return pa.RecordBatch.from_arrays(
            [pa.array(tv.signed(fp)), pa.array(check.astype(np.int64)), pa.array(tv.signed(ptr)),
             pa.array(count.astype(np.int64)), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], FOUND)

    def run(batches):
        now, parts, words = None, [], {}
        for batch in batches:
            for bucket, block, lang, k in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None:
                    words[lang] = words.get(lang, 0) + k
                    continue
                if bucket != now and parts:
                    yield found(parts)
                    parts = []
                now = bucket
                parts.append(tv.unpack(block, KINDS))
        if parts:
            yield found(parts)
        if words:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(words), pa.int64())] * 4 + [pa.array(list(words), pa.string()),
                                                          pa.array(list(words.values()), pa.int64())], FOUND)
    return run


FOUND = ["fp", "ck", "ptr", "a", "lang", "words"]


def counted(texts: DataFrame, n: int, sketch, bits: int, least: int, fp_bits: int = 64) -> DataFrame:
    """``FOUND_SCHEMA``: frequent n-grams, and for n = 1 rows (lang, words) of all words."""
    rounds = -(-bits // FAN_BITS)
    step = -(-bits // rounds)
    dealt = texts.mapInArrow(_count(n, sketch, step, fp_bits), BLOCK_SCHEMA)
    for k in range(2, rounds + 1):
        dealt = dealt.repartition("bucket").mapInArrow(_regroup(min(bits, step * k)), BLOCK_SCHEMA)
    return staged(dealt.repartition("bucket").sortWithinPartitions("bucket")
                  .mapInArrow(_merge(least), FOUND_SCHEMA), f"phrases-{n}")


CUT_SCHEMA = "lang string, fp long, ck long, a long, n int, phrase string, k int, lfp long, lck long, rfp long, rck long"
CUT = [f.split()[0] for f in CUT_SCHEMA.split(", ")]


def _materialise(fp_bits: int):
    """Rows (lang, body, pointers) -> a row per cut of every phrase that is where its pointer says.
    Equal texts of a batch are read once."""
    def run(batches):
        for batch in batches:
            out, done = [], set()
            codes, names, hashes = language_hashes(batch.column(0))
            wanted = batch.column(2).to_pylist()
            for first, off, data in tv.byte_runs(batch.column(1)):
                r = Run(first, off, data)
                lang = hashes[codes[r.row]] if len(r.row) else np.zeros(0, U)
                for i in range(len(off) - 1):
                    text = data[off[i]:off[i + 1]].tobytes()
                    key = (codes[first + i], hashlib.blake2b(text, digest_size=16).digest())
                    if key in done:
                        continue
                    done.add(key)
                    low, high = r.offsets[i], r.offsets[i + 1]
                    for n, group in _by_length(wanted[first + i]).items():
                        at = low + np.array([g["pos"] for g in group])
                        fits = at + n <= high
                        group, at = [g for g, f in zip(group, fits) if f], at[fits]
                        if not group:
                            continue
                        fp, check = r.grams(at, n, lang[at], fp_bits)
                        parts = {(j, m): [tv.signed(x) if x.dtype == U else x.astype(np.int64)
                                          for x in r.grams(at + j, m, lang[at], fp_bits)]
                                 for k in range(1, n) for j, m in ((0, k), (k, n - k))}
                        fp, check = tv.signed(fp), check.astype(np.int64)
                        for x, g in enumerate(group):
                            if fp[x] != g["fp"] or check[x] != g["ck"]:
                                continue
                            p = b" ".join(data[r.starts[w]:r.ends[w]].tobytes() for w in range(at[x], at[x] + n)).lower()
                            for k in range(1, n):
                                out.append((names[codes[first + i]], int(fp[x]), int(check[x]), g["a"], n, p.decode(), k,
                                            *(int(v[x]) for v in (*parts[0, k], *parts[k, n - k]))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if f in ("lang", "phrase") else pa.int32() if f in ("n", "k") else pa.int64())
                     for c, f in zip(zip(*out), CUT)], CUT)
    return run


def _by_length(pointers: list) -> dict:
    out: dict = {}
    for p in pointers:
        out.setdefault(p["fp"] & ((1 << LENGTH_BITS) - 1), []).append(p)
    return out


def phrase_cuts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                longest: int = LONGEST, filter_bits: int = FILTER_BITS, fp_bits: int = 64,
                bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cuts, counts, totals): a row per cut of each frequent phrase, the occurrences of every
    frequent n-gram by (fp, ck), and the words per language."""
    if not 2 <= longest < 1 << LENGTH_BITS:
        raise ValueError(f"longest must be 2 to {(1 << LENGTH_BITS) - 1}")
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.filter(F.octet_length(text_col) > 0).select(
        lang.alias("lang"), F.xxhash64(lang, F.col(text_col)).bitwiseAND(0xFFFFFFFF).alias("key"),
        F.col(text_col).cast("binary").alias("body"))
    levels = [counted(texts, 1, None, FAN_BITS, least, fp_bits)]
    totals = levels[0].filter("words is not null").groupBy("lang").agg(F.sum("words").alias("n"))
    words = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(6, (words // bucket_words).bit_length())
    for n in range(2, longest + 1):
        release(spark)
        sketch = spark.sparkContext.broadcast(bit_table(levels[-1].filter("fp is not null").select("fp"), filter_bits))
        levels.append(counted(texts, n, sketch, bits, least, fp_bits))
        sketch.unpersist()
    release(spark)
    counts = levels[0].filter("fp is not null").select("fp", "ck", "a")
    for found in levels[1:]:
        counts = counts.union(found.select("fp", "ck", "a"))
    frequent = levels[1]
    for found in levels[2:]:
        frequent = frequent.union(found)
    pointers = (frequent.select(F.shiftrightunsigned("ptr", 32).alias("key"), F.struct(
        F.col("ptr").bitwiseAND(0xFFFFFFFF).alias("pos"), "fp", "ck", "a").alias("p"))
        .groupBy("key").agg(F.collect_list("p").alias("pointers")))     # at most a text's n-grams per key
    cuts = (texts.join(pointers.hint("shuffle_merge"), "key").select("lang", "body", "pointers")
            .mapInArrow(_materialise(fp_bits), CUT_SCHEMA).dropDuplicates(["fp", "ck", "k"]))
    return staged(cuts, "phrase-cuts"), counts, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, **sizes) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases."""
    cuts, counts, totals = phrase_cuts(docs, text_col, lang_col, least, longest, **sizes)
    part = lambda side: counts.select(
        F.col("fp").alias(f"{side}fp"), F.col("ck").alias(f"{side}ck"), F.col("a").alias(side))
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    scored = (cuts.join(part("l"), ["lfp", "lck"]).join(part("r"), ["rfp", "rck"])
              .withColumn("aa", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")).cast("decimal(31,0)"))
              .withColumn("lr", (exact("l") * exact("r")).cast("decimal(38,0)"))
              .withColumn("score", F.expr("aa div lr").cast("long")))
    best = (scored.groupBy("fp", "ck").agg(F.min(F.struct("score", "k", "l", "r", "lang", "phrase", "a")).alias("b"))
            .select("fp", "ck", "b.*"))
    inner = (cuts.filter("k = 1").select(F.col("rfp").alias("fp"), F.col("rck").alias("ck"), "a", "n")
             .union(cuts.filter("k = n - 1").select("lfp", "lck", "a", "n"))
             .filter("n > 2").groupBy("fp", "ck").agg(F.max("a").alias("longer")))
    left = best.join(inner, ["fp", "ck"], "left").filter(f"longer is null or 100 * longer < {int(inside)} * a")
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language's phrases are ranked in TOP_PARTS parts first, so its last task gets at most that many times top
    left = left.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(TOP_PARTS))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).filter(F.col("rank") <= top)
    first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
