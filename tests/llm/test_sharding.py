import random
import zlib

from cases import documents
from pyspark.sql import functions as F

from ticketlens.llm import sharding
from ticketlens.llm.queries import op6_sharding


def _jump(key, shards):
    """The published loop, in plain whole numbers."""
    key %= 1 << 64
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jumps_by_the_published_loop(spark):
    rng = random.Random(2)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randint(-(2**63), 2**63 - 1) for _ in range(500)), *range(2, 400)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 50):
        for r in frame.select("k", sharding.jumps(F.col("k"), shards).alias("j")).collect():
            assert (r["j"]["shard"], r["j"]["grown"]) == (_jump(r["k"], shards), _jump(r["k"], shards + 1))
            assert r["j"]["grown"] in (r["j"]["shard"], shards)


def _check(rows, texts):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts
    )


def test_awkward_rows(awkward, nothing):
    rows = sharding.sharded(awkward, 3).collect()
    _check(rows, [r["text"] for r in awkward.collect()])
    assert all(r["shard"] == _jump(r["key"] or 0, 3) for r in rows)
    assert sharding.sharded(nothing, 8).collect() == []


def test_one_key_for_most_rows(spark):
    rows = [(5, "same", "en", "s", 4)] * 500 + [(i, "other", "en", "s", 5) for i in range(100)]
    found = sharding.sharded(documents(spark, rows).repartition(7), 4).collect()
    _check(found, [r[1] for r in rows])


def test_other_keys(spark):
    frame = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "k string, text string")
    rows = sharding.sharded(frame, 4, key="k").collect()
    assert {r["key"] for r in rows} == {"a", "b", None} and all(0 <= r["shard"] < 4 for r in rows)


def test_query_is_balanced(spark, sf_dir):
    rows = op6_sharding(spark, sf_dir).collect()
    assert {r["shard"] for r in rows} == set(range(8))
    assert {r["law"] for r in rows} == {"key"}
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 8 for r in moved) and len(moved) < len(rows) / 4
