"""Language identification by error-correcting output codes.

Every language has a codeword of ``bits``.  A binary n-gram classifier per bit says on which
side of the bit's split of the languages a text lies, and the codeword with the smallest
weighted loss wins.

* *Features*: texts are lower-cased, everything but letters becomes one space, and the runs of
  1 to 3 UTF-8 bytes are hashed to ``BUCKETS`` counts.
* *Training*: one distributed aggregation of n-gram counts per language over all labelled
  training rows (no sample).  The classifier of a bit is a naive Bayes of its two sides; each
  language weighs the same on its side, however many texts it has.
* *Codewords*: all splits for up to 5 languages, otherwise ``CODE_BITS`` seeded random splits,
  no two languages alike.
* *Decoding*: a bit's margin is the mean log odds per n-gram, scaled to its typical size; the
  loss of a codeword is the weighted mean of log(1 + exp(-code * margin)).  A bit's weight is
  the share of training texts it puts on the right side, above chance (measured in a second
  pass over the training rows).
* ``score`` is the softmax of the losses over the languages, and a text whose two best
  codewords are close (``score`` under ``AMBIGUOUS``) is flagged.

Defined cases: texts that are null, empty or without a letter give ``und`` with score 0; if no
labelled row exists every text gives ``und``; whole texts are read; the language, source and
id columns are never inputs of a prediction.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

BUCKETS = 1 << 15
CODE_BITS = 31
MAX_LANGUAGES = 512
AMBIGUOUS = 0.5
SHARP = 6.0                                     # of the softmax over codewords
UND = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
U = np.uint32


def grams(text: str) -> np.ndarray:
    """Hashed buckets of all 1- to 3-byte runs of a text's letters; empty without letters."""
    if not text or not _LETTER.search(text):
        return np.zeros(0, np.int64)
    b = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8).astype(U)
    with np.errstate(over="ignore"):
        one = b * U(0x9E3779B1)
        two = (one[:-1] ^ U(0x85EBCA77)) + b[1:] * U(0xC2B2AE3D)
        three = (two[:-1] * U(0x27D4EB2F) ^ U(0x165667B1)) + b[2:] * U(0x85EBCA6B)
        h = np.concatenate([one, two * U(0x9E3779B1), three * U(0x9E3779B1)])
        h = (h ^ h >> U(15)) * U(0x2C1B3C6D)
    return (h >> U(17)).astype(np.int64)


def code_matrix(n: int) -> np.ndarray:
    """n codewords of +1 / -1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:                                   # all splits; the first language is always +1
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(20), max(CODE_BITS, 4 * int(np.ceil(np.log2(n))))
    while True:
        code = rng.choice((1.0, -1.0), size=(n, bits))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all():
            return code


def _counts(batches):
    """Summed n-gram counts per language of a task, as (lang, bucket, k) rows."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            g = grams(text.as_py())
            if len(g):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += np.bincount(g, minlength=BUCKETS)
    for lang, k in total.items():
        at = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(k[at])], ["lang", "bucket", "k"])


class Model:
    """languages, codewords, one row of log odds per bucket, and the bits' scales and weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, code_matrix(len(langs))
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)      # language x bucket
        sides = []
        for bit in self.code.T:
            plus, minus = p[bit > 0], p[bit < 0]
            sides.append(np.log(plus.mean(axis=0)) - np.log(minus.mean(axis=0)) if len(minus) else np.ones(BUCKETS))
        self.odds = np.array(sides, np.float32).T.copy()                    # bucket x bit
        typical = np.abs(p @ self.odds).mean(axis=0)
        self.scale = np.where(typical > 0, typical, 1.0)
        self.weight = np.ones(self.code.shape[1])

    def margins(self, text: str) -> np.ndarray | None:
        g = grams(text)
        if not len(g):
            return None
        if len(g) > 2 * BUCKETS:                 # long texts: by counts, the same sum
            return np.bincount(g, minlength=BUCKETS) @ self.odds.astype(np.float64) / len(g) / self.scale
        return self.odds[g].sum(axis=0, dtype=np.float64) / len(g) / self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return np.log1p(np.exp(-self.code * margins * 2)) @ self.weight / self.weight.sum()

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score 0 to 1, ambiguous)."""
        m = self.margins(text) if self.langs else None
        if m is None:
            return UND, 0.0, True
        loss = self.losses(m)
        share = np.exp(-SHARP * (loss - loss.min()))
        best = int(np.argmin(loss))              # ties: the first in the order of names
        score = float(share[best] / share.sum())
        return self.langs[best], score, score < AMBIGUOUS


def _bit_hits(sent):
    def run(batches):
        model = sent.value
        place = {lang: i for i, lang in enumerate(model.langs)}
        hits, n = np.zeros(model.code.shape[1], np.int64), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = model.margins(text.as_py())
                if m is not None:
                    hits += m * model.code[place[lang]] > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hits), dtype=np.int32)), pa.array(hits),
                                          pa.array(np.full(len(hits), n))], ["bit", "hits", "n"])
    return run


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of all rows with a language.  What comes back is one count per language and
    bucket (at most MAX_LANGUAGES x BUCKETS numbers) and one hit count per bit."""
    spark = rows.sparkSession
    known = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"),
                                                            F.col(text_col).cast("string").alias("text"))
    sums = staged(known.mapInArrow(_counts, "lang string, bucket int, k long").groupBy("lang", "bucket")
                  .agg(F.sum("k").alias("k")), "language-counts")
    langs = sorted(r[0] for r in sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    got = sums.toArrow()
    np.add.at(counts, ([place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()), got["k"].to_numpy())
    model = Model(langs, counts)
    if langs:
        sent = spark.sparkContext.broadcast(model)
        bits = (known.mapInArrow(_bit_hits(sent), "bit int, hits long, n long")
                .groupBy("bit").agg((F.sum("hits") / F.greatest(F.sum("n"), F.lit(1))).alias("right")).collect())
        for r in bits:
            model.weight[r["bit"]] = max(0.05, 2 * r["right"] - 1)
    return model


def _predict(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            lang, score, vague = zip(*got) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(vague, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])
    return run


def held_out(id_col: str):
    """True for the fifth of documents kept out of training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, ambiguous)`` per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _predict(sent), "id long, lang_pred string, score double, ambiguous boolean")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: ``(id, held_out, lang_pred, score, ambiguous)``."""
    model = train(docs.filter(~held_out(id_col)), lang_col, text_col)
    return identify(docs, model, id_col, text_col).withColumn("held_out", held_out("id"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is told: neither ``und`` nor ambiguous."""
    model = train(docs.filter(~held_out(id_col)), lang_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(text):
        import pandas as pd
        got = [sent.value.predict(t) for t in text]
        return pd.Series([lang != UND and not vague for lang, _, vague in got], dtype=bool)

    return docs.filter(told(F.col(text_col).cast("string")))
