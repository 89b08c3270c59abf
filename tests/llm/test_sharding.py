import zlib
from collections import Counter

import numpy as np

from quire.llm import sharding


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1.0)))
    return b


def test_as_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 2000, dtype=np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(2).integers(0, 2**64, 50_000, dtype=np.uint64)
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert set(b[a != b]) == {40} and abs((a != b).mean() - 1 / 41) < 0.005
    assert max(Counter(a.tolist()).values()) < 1.15 * len(keys) / 40


def test_layout(make, odd_texts):
    df = make([*odd_texts, *[(7, "same")] * 50, *[(i, f"text {i}") for i in range(100, 400)]])
    got = sharding.layout(df, shards=5).collect()
    assert len(got) == df.count()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(len({r["shard"] for r in got if r["doc_id"] == i}) == 1 for i in {r["doc_id"] for r in got})
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)
    assert sharding.layout(make([])).count() == 0


def test_written_shards(spark, make, tmp_path):
    df = make([f"text {i}" for i in range(50)], extra=False)
    sharding.write_shards(df, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}
