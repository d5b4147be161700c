import zlib

import pytest

from tallyrake.llm.sharding import shard_by_bytes
from tests.llm.fixtures import corpus, frame


def held(rows, got, shards):
    size = {}
    assert sorted((r["id"], r["size"], r["text_crc32"]) for r in got if r["id"] is not None) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / shards, max(r["size"] for r in got)
    assert set(size) <= set(range(shards))
    assert all(abs(v - mean) <= largest for v in size.values())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sizes_are_near_equal(spark, shards):
    rows = [x for x in corpus(2) if x[0] != 206] + [(None, "nameless"), (3, "twice"), (3, "twice")]
    held(rows, shard_by_bytes(frame(spark, rows), shards).collect(), shards)


def test_one_text_holds_most_rows(spark):
    rows = [(i, "the same text in many rows") for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(900)]
    got = shard_by_bytes(frame(spark, rows), 8, extra=("lang",)).collect()
    held(rows, got, 8)
    small = [x for x in rows if x[0] < 8]
    held(small, shard_by_bytes(frame(spark, small), 40).collect(), 40)


def test_same_shards_whatever_the_partitions(spark):
    rows = [x for x in corpus(2) if x[0] != 206]
    a, b = (sorted(map(tuple, shard_by_bytes(frame(spark, rows, n), 5).collect())) for n in (1, 7))
    assert a == b
    assert shard_by_bytes(frame(spark, rows).limit(0), 5).collect() == []
