import hashlib

import numpy as np
import pyarrow as pa
import pytest

from draftmill.llm import exact_dedup
from draftmill.llm.exact_dedup import exact_duplicates


def expected(records, keep):
    groups = {}
    for i, t in records:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in records:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        out.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


# One digest byte makes different texts collide; a tiny memtable makes many runs and tiers.
@pytest.mark.parametrize(("keep", "digest_bytes", "memtable_rows"), [("max", 32, 500_000), ("min", 1, 3)])
def test_equals_grouping(docs, records, rows, keep, digest_bytes, memtable_rows):
    found = exact_duplicates(docs, keep=keep, digest_bytes=digest_bytes, memtable_rows=memtable_rows)
    assert rows(found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == expected(records, keep)


def test_null_ids_alone_all_stay(spark, rows):
    df = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [(r[1], r[2], r[3]) for r in rows(exact_duplicates(df))] == [(None, 2, True)] * 2


def test_no_rows(empty):
    assert exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("runs", [1, 3, 20])  # alone, merged once, in tiers
def test_runs_of_several_chunks_are_whole(runs):
    rng = np.random.default_rng(runs)
    names, blobs, filters, want = [], [], [], {}
    for r in range(runs):
        digests = sorted(f"{k:06d}".encode() for k in set(rng.integers(0, 4000, 900).tolist()))
        table = pa.Table.from_arrays([pa.array(digests), pa.array([r * 10_000 + k for k in range(len(digests))]), pa.array([1] * len(digests))], schema=exact_dedup._ENTRY)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, exact_dedup._ENTRY) as out:
            out.write_table(table, max_chunksize=100)
        blobs.append(sink.getvalue().to_pybytes())
        filters.append(exact_dedup._Filter.of(*exact_dedup._halves(table["digest"])).raw())
        for d, i in zip(digests, table["keep"].to_pylist(), strict=True):
            old = want.get(d, (i, 0))
            want[d] = (min(old[0], i), old[1] + 1)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * runs, pa.int32()), pa.array(blobs, pa.binary()), pa.array(filters, pa.binary())], ["shard", "run", "filter"])
    got = pa.Table.from_batches(exact_dedup._compaction("min")(iter([batch])))
    assert {d: (i, n) for d, i, n in zip(*[c.to_pylist() for c in got.columns], strict=True)} == want and len(got) == len(want)


def test_a_filter_travels_with_its_run():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 62, (2, 5000), np.uint64)
    read = exact_dedup._Filter.read(exact_dedup._Filter.of(a, b | np.uint64(1)).raw())
    assert read.may_hold(a, b | np.uint64(1)).all() and read.may_hold(*rng.integers(0, 1 << 62, (2, 5000), np.uint64)).mean() < 0.05
