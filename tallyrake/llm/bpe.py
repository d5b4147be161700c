"""BPE encoding by a distinct-word table, and decoding through an id-to-piece join.

Byte-level BPE never merges across words, so a text's ids are its words' ids in order.

1. *Word table*: texts are split into words in Spark tasks, words are counted with map-side
   combining, and ``TABLE_WORDS`` frequent ones (a documented bound on what is sent to every
   task; words met once between two flushes of a task are not counted, so not exactly the most
   frequent ones) are encoded once each by the tokenizers library.  Their ids are exploded and
   joined with the id-to-piece table (a fixed vocabulary of 50,257 rows), which gives each word
   the bytes that its ids decode to.
2. *Join by position*: every task looks its texts' words up in that table, in order; a word
   outside of it (a rare one) is encoded once by the task that meets it and kept in a bounded
   store.  No occurrence of a word is shuffled.
3. *Decode*: the pieces that the join gave for the words' ids are put together by position (rare
   words: from the same id-to-piece table in the task); bytes that are not UTF-8 become U+FFFD,
   as in the library.

Words come from the tokenizer's own split pattern (its ByteLevel pre-tokenizer).  Texts that
hold only ASCII and Latin-1 letters are split with an equal pattern of Python's ``re``, which
is fast; others with the library's pre-tokenizer itself.  The strings of added tokens (such as
``<|endoftext|>``) are cut out of texts first, as the library does by default.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows
and null ids give a row each; very long texts are encoded whole in one task; which of equally
frequent words the table holds changes no result; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_WORDS = 1 << 17
ROUND_TRIP_WORDS = 1 << 18                       # rare words kept in a task, beside the table
TASK_WORDS = 3 << 18

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: Texts of these characters only: the two patterns split them alike.
_PLAIN = re.compile(r"[\t-\r -~ªµºÀ-ÖØ-öø-ÿ]*\Z")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


class Codec:
    """A tokenizer file of byte-level BPE in one task: words of texts, ids of words, pieces of ids."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.written = {b: c for c, b in _byte_of().items()}
        self.piece = pieces(spec)
        self.table: dict | None = None
        self.known = _Known({}, self._pair)
        self.alone = _Known({}, lambda word: array("I", self.ids(word)).tobytes())

    def words(self, text: str) -> list[str]:
        """The words of a text; their concatenation is the text."""
        out, at = [], 0
        for hit in self.cut.finditer(text) if self.cut else ():
            out += self._split(text[at:hit.start()])
            out.append(hit.group())
            at = hit.end()
        return out + self._split(text[at:]) if out or at else self._split(text)

    def _split(self, text: str) -> list[str]:
        if _PLAIN.match(text):
            return _SPLIT.findall(text)
        got = self.tok.pre_tokenizer.pre_tokenize_str(text)
        spans = [s for _, s in got]
        return [text[a:b] for a, b in spans]

    def ids(self, word: str) -> list[int]:
        """Ids of one word, by the library's own BPE model."""
        if word in self.added:
            return [self.added[word]]
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.written))]

    def _pair(self, word: str) -> tuple[bytes, bytes]:
        ids = self.ids(word)
        return array("I", ids).tobytes(), b"".join([self.piece[i] for i in ids])

    def entries(self, texts: list[str], table: dict) -> list[list[tuple[bytes, bytes]]]:
        """Per text its words' (packed ids, decoded bytes), joined by position with the table;
        words outside of it are encoded once and kept."""
        if self.table is not table or len(self.known) > len(table) + ROUND_TRIP_WORDS:
            self.table, self.known = table, _Known(table, self._pair)
        return [list(map(self.known.__getitem__, self.words(t))) for t in texts]

    def forget(self) -> None:
        """Let go of the words of a task: the process stays and serves other steps."""
        self.table, self.known = None, _Known({}, self._pair)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers; a word is encoded once and kept."""
        if len(self.alone) > TASK_WORDS:
            self.alone.clear()
        return [b"".join(map(self.alone.__getitem__, self.words(t))) for t in texts]


class _Known(dict):
    """Words and their entries; a new word's entry is made when it is met."""

    def __init__(self, table: dict, make):
        super().__init__(table)
        self.make = make

    def __missing__(self, word: str):
        entry = self[word] = self.make(word)
        return entry


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(spec: str) -> dict[int, bytes]:
    """Bytes of every id of the vocabulary (an added token: its text)."""
    byte = _byte_of()
    tok = json.loads(spec)
    out = {i: (bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode())
           for w, i in tok["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in tok.get("added_tokens", [])}


def read_spec(path: str) -> str:
    """The tokenizer file, read once by the driver and sent along (tasks need no local copy)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _batches(column: pa.Array, limit: int = 1 << 21):
    """Texts of a column in runs of about ``limit`` bytes; null is empty."""
    run, size = [], 0
    for s in column:
        run.append(s.as_py() or "")
        size += len(run[-1])
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _count_words(spec):
    def run(batches):
        from collections import Counter
        c = codec(spec.value)
        seen: Counter[str] = Counter()

        def out():
            often = [(w, k) for w, k in seen.items() if k > 1]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()),
                                               pa.array([k for _, k in often], pa.int64())], ["word", "k"])
        for batch in batches:
            for texts in _batches(batch.column(0)):
                for t in texts:
                    seen.update(c.words(t))
                if len(seen) > ROUND_TRIP_WORDS:
                    yield out()
                    seen.clear()
        yield out()
    return run


def _encode_words(spec):
    def run(batches):
        c = codec(spec.value)
        for batch in batches:
            ws = batch.column(0).to_pylist()
            ids = [c.ids(w) for w in ws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])
    return run


def word_table(docs: DataFrame, spec: str, text_col: str = "text", limit: int = TABLE_WORDS) -> DataFrame:
    """``(word, ids array<int>, bytes binary)`` of the most frequent words, each encoded once;
    ``bytes`` come from joining the ids with the id-to-piece table."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(spec)
    counted = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words(sent), "word string, k long")
               .groupBy("word").agg(F.sum("k").alias("k")))
    top = counted.orderBy(F.desc("k"), "word").limit(limit).select("word")
    ids = top.mapInArrow(_encode_words(sent), "word string, ids array<int>")
    vocab = spark.createDataFrame([(i, bytearray(p)) for i, p in pieces(spec).items()], "id int, piece binary")
    flat = ids.select("word", F.posexplode("ids").alias("at", "id")).join(F.broadcast(vocab), "id", "left")
    return (flat.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "id", "piece"))).alias("p"))
            .select("word", F.col("p.id").alias("ids"),
                    F.unhex(F.array_join(F.transform("p.piece", lambda x: F.hex(x)), "")).alias("bytes")))


def _round_trip(spec, table, keep_text: bool):
    def run(batches):
        c = codec(spec.value)
        of_word = table.value
        try:
            for batch in batches:
                ids_in, n, sha_ids, sha_text, texts_out = batch.column(0), [], [], [], []
                for texts in _batches(batch.column(1)):
                    for got in c.entries(texts, of_word):
                        packed = b"".join([g[0] for g in got])
                        text = b"".join([g[1] for g in got]).decode("utf-8", "replace")
                        n.append(len(packed) // 4)
                        sha_ids.append(hashlib.sha256(packed).hexdigest())
                        sha_text.append(hashlib.sha256(text.encode()).hexdigest())
                        if keep_text:
                            texts_out.append(text)
                cols = [ids_in, pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_text:
                    cols.append(pa.array(texts_out, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            c.forget()
    return run


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               keep_text: bool = False, limit: int = TABLE_WORDS) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, decoded])`` per row: encoded, then decoded."""
    spec = read_spec(tokenizer)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(spec)
    rows = word_table(docs, spec, text_col, limit).toArrow().to_pydict()        # at most ``limit`` rows
    table = {w: (np.asarray(i, "<u4").tobytes(), b) for w, i, b in zip(rows["word"], rows["ids"], rows["bytes"])}
    store = spark.sparkContext.broadcast(table)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_round_trip(sent, store, keep_text),
                          "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * keep_text)


def _ids(spec):
    def run(batches):
        c = codec(spec.value)
        for batch in batches:
            packed = [p for texts in _batches(batch.column(1)) for p in c.packed(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "packed"])
    return run


def encode_packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(id, packed)`` of ``(id, text)`` rows: ids as little-endian 32-bit integers; each task
    encodes a word once."""
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    return docs.mapInArrow(_ids(sent), "id long, packed binary")
