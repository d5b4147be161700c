import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyrake.llm.bpe import Codec, read_spec, round_trip, word_table
from tallyrake.llm.token_files import GAP, document_starts, read_documents, read_token_files, seek_table, write_token_files
from tests.llm.fixtures import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|>", "a<|endoftext|> b", "<|endoftext", "it's  I'LL\n\n\n x ", "tab\t\tx", "½ ²x µ ª 5٣", "日本語 テキスト",
       "é x y  z　", "\x1c\x1d a\x85b", "🙂👍🏽 ok", "​﻿", "''s''", " ", "  ", "\r\n\r\n", "a" * 3000, "x  "]


def test_words_give_the_same_ids_for_all_characters():
    tok, codec = Tokenizer.from_file(PATH), Codec(read_spec(PATH))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 61 == 0 or unicodedata.category(chr(c)) == "Zs")]
    r = random.Random(3)
    texts = ODD + ["".join(r.choice([" ", "a", "B", "'s", "7", "\n", "!", c]) for c in chars[i:i + 50] for _ in (0, 1)) for i in range(0, len(chars), 50)]
    texts += ["".join(r.choice("ab é9 '\n\t.s") for _ in range(40)) for _ in range(2000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    entries = codec.entries(texts, {})
    assert [np.frombuffer(b"".join(g[0] for g in x), "<u4").tolist() for x in entries] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.packed(texts)] == want
    back = [b"".join(g[1] for g in x).decode("utf-8", "replace") for x in entries]
    assert back == [tok.decode(x, skip_special_tokens=False) for x in want]


def brute(rows):
    tok = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [1 << 17, 5])
def test_round_trip_equals_the_library(spark, limit):
    rows = corpus(3) + [(700 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (700, ODD[0])]
    got = round_trip(frame(spark, rows), PATH, limit=limit, keep_text=True)
    assert sorted(map(tuple, (r[:4] for r in got.collect())), key=str) == sorted(brute(rows), key=str)
    assert round_trip(frame(spark, rows).limit(0), PATH).collect() == []


def test_word_table_joins_ids_with_pieces(spark):
    rows = word_table(frame(spark, corpus(3)), read_spec(PATH)).collect()
    assert len(rows) > 100 and all(bytes(r["bytes"]).decode() == r["word"] for r in rows)


def brute_starts(rows):
    tok, out, at = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_bytes,frame_bytes", [(1 << 30, 1 << 18), (20_000, 3_000)])
def test_files_round_trip(spark, tmp_dir, file_bytes, frame_bytes):
    rows = corpus(4) + [(700 + k, t) for k, t in enumerate(ODD)]
    path = f"{tmp_dir}/tokens"
    write_token_files(frame(spark, rows), path, PATH, file_bytes=file_bytes, frame_bytes=frame_bytes)
    want = brute_starts(rows)
    assert sorted(map(tuple, document_starts(spark, path).collect())) == want
    some = {w[0] for w in want[::7]}
    got = read_token_files(spark, path, some).collect()
    assert {r["id"] for r in got} == some and all(r["ids_crc32"] == zlib.crc32(r["packed"]) for r in got)


def test_readers_touch_only_the_frames_asked_for(spark, tmp_dir):
    import glob

    import zstandard
    path = f"{tmp_dir}/tokens"
    write_token_files(frame(spark, corpus(4)), path, PATH, frame_bytes=2_000)
    data = bytearray(open(glob.glob(f"{path}/part-*")[0], "rb").read())
    table = seek_table(bytes(data))
    assert len(table["frames"]) > 10
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()    # a plain zstandard file
    assert len(whole) == sum(f[2] for f in table["frames"])
    last, first = table["docs"][0][-1], table["docs"][0][0]
    data[table["frames"][0][0] + 20] ^= 255
    assert list(read_documents(bytes(data), [last]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(read_documents(bytes(data), [first]))
    with pytest.raises(ValueError):
        seek_table(bytes(data[:-len(GAP) - 3]))


def test_empty_tables_make_no_documents(spark, tmp_dir):
    write_token_files(frame(spark, corpus(4)).limit(0), f"{tmp_dir}/none", PATH)
    assert document_starts(spark, f"{tmp_dir}/none").collect() == []


def test_files_are_counted_by_part_number(spark, tmp_dir):
    import glob
    import os
    import shutil
    rows = corpus(4)
    write_token_files(frame(spark, rows), f"{tmp_dir}/tokens", PATH, file_bytes=100_000)
    files = sorted(glob.glob(f"{tmp_dir}/tokens/part-*"))
    assert len(files) > 2
    os.mkdir(f"{tmp_dir}/part-7-many")
    for k, f in enumerate(files):                # 99999, 100000, ...: names as Spark gives them
        shutil.copy(f, f"{tmp_dir}/part-7-many/" + os.path.basename(f).replace(f"part-{k:05d}", f"part-{99_999 + k:05d}"))
    assert sorted(map(tuple, document_starts(spark, f"{tmp_dir}/part-7-many").collect())) == brute_starts(rows)
