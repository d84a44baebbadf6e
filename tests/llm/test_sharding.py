import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from draftmill.llm import sharding


def _slot(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)  # as Spark's xxhash64 of one string
    return (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS


def test_positions_and_sizes(docs, records, rows):
    got = sharding.shard_positions(docs, 8).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in records), key=repr)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_bytes_are_near_equal_with_a_hot_group(spark):
    hot = [(k, "same text " * 30) for k in range(3000)]
    rest = [(5000 + k, f"{k} " * (10 + k % 90)) for k in range(5000)]
    slot = lambda t: spark.range(1).select(sharding.slot_of(F.xxhash64(F.lit(t)))).first()[0]
    own = slot(hot[0][1])
    beside = next(t for t in map("beside {}".format, range(10**6)) if _slot(t) == own)
    assert slot(beside) == own
    rest += [(20_000 + k, beside) for k in range(40)]  # in the slot of the hot text, and not parted
    df = spark.createDataFrame(hot + rest, "doc_id long, text string")
    total = np.zeros(8)
    homes = {}
    for r in sharding.shard_positions(df, 8).collect():
        total[r.shard] += r["size"]
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert total.max() - total.min() < 0.01 * total.mean()
    # Only the group that no shard could take whole is split.
    assert [c for c, s in homes.items() if len(s) > 1] == [zlib.crc32(hot[0][1].encode())]


def test_rows_keep_their_columns(docs, records, empty):
    out, plan = sharding.shard_rows(docs, 3)
    assert out.columns == [*docs.drop("shard").columns, "shard"] and out.count() == len(records)
    again, _ = sharding.shard_rows(docs, 3, plan=plan)
    assert sorted(map(repr, out.select("doc_id", "shard").collect())) == sorted(map(repr, again.select("doc_id", "shard").collect()))
    assert sharding.shard_rows(empty, 3)[0].count() == 0 and sharding.shard_positions(empty, 3).count() == 0


@pytest.mark.parametrize("shards", [1, 8])
def test_map_edits(spark, shards):
    rng = np.random.default_rng(shards)
    size = {(s, -1): int(n) for s, n in enumerate(rng.integers(1, 100_000, sharding.SLOTS))}
    first = sharding.SlotMap.initial(shards)
    plan = first.rebalanced(size)
    load = lambda m: np.bincount([m.shard_of[k] for k in size], [size[k] for k in size], m.shards)
    assert plan.version == 2 and np.ptp(load(plan)) <= sharding.TOLERANCE * load(plan).mean()
    assert sum(first.shard_of[k] != s for k, s in plan.shard_of.items()) < len(size) / 4
    again = plan.rebalanced(size)
    assert again.shard_of == plan.shard_of and again.version == 3
    more = plan.grown(size)
    moved = [k for k, s in more.shard_of.items() if s != plan.shard_of[k]]
    assert moved and all(more.shard_of[k] == shards for k in moved) and more.shards == shards + 1
    assert load(more)[shards] == pytest.approx(load(more).sum() / (shards + 1), rel=0.1)
    assert more.table(spark).count() == sharding.SLOTS


def test_a_map_that_is_read_back_grows(spark, tmp_path):
    hot, rest = [(k, "same text " * 30) for k in range(1500)], [(5000 + k, f"{k} " * (10 + k % 90)) for k in range(3000)]
    docs = spark.createDataFrame(hot + rest, "doc_id long, text string")
    _, plan = sharding.shard_rows(docs, 4)
    assert len(plan.hot) == 1
    plan.save(spark, str(tmp_path / "map"))
    read = sharding.SlotMap.read(spark.read.parquet(str(tmp_path / "map")))
    assert read == plan
    more = read.grown(sharding.sizes_of(docs, read))
    more.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.read(spark.read.parquet(str(tmp_path / "map"))) == more
    assert sharding.SlotMap.read(spark.read.parquet(str(tmp_path / "map")), plan.version) == plan
    before = {r.doc_id: r.shard for r in sharding.shard_rows(docs, 4, plan=plan)[0].collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_rows(docs, 5, plan=more)[0].collect()}
    moved = [i for i in before if before[i] != after[i]]
    assert moved and {after[i] for i in moved} == {4}
    size = np.bincount([after[i] for i, _ in hot + rest], [len(t) + 1 for _, t in hot + rest])
    assert size[4] > 0.8 * size.mean()
    with pytest.raises(ValueError, match="version"):
        sharding.SlotMap.read(spark.read.parquet(str(tmp_path / "map")), 99)
