import math
import zlib
from collections import Counter

import numpy as np
import pytest

from draftmill.llm import lm_scoring


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def exact(records):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in records]
    c, pairs = Counter(), Counter()
    for (_, t), h in zip(records, held, strict=True):
        if not h:
            w = tokens(t)
            c.update(w)
            pairs.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    level = lambda k: 0 if not k else lm_scoring._LEVEL[k.bit_length()]
    out = []
    for (i, t), h in zip(records, held, strict=True):
        w = tokens(t)
        share = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
        base = sum(math.log10(share(x)) for x in w)
        score = sum(math.log10(0.5 * share(x) + 0.5 * min(1, level(pairs[p, x]) / c[p]) if c[p] else share(x)) for p, x in zip([None, *w[:-1]], w, strict=True))
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("most", [128 << 20, 4096])  # one pass, and several
def test_equals_exact_counts(docs, records, most):
    got = sorted((tuple(r) for r in lm_scoring.lm_scores(docs, most=most).collect()), key=lambda r: repr(r[:4]))
    expected = sorted(exact(records), key=lambda r: repr(r[:4]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in expected], rel=1e-12)
    # The filter errs by its false hits alone, and only upwards.
    assert np.mean([abs(a[6] - b[6]) / abs(b[6]) for a, b in zip(got, expected, strict=True)]) < 0.03
    assert all(a[6] >= b[6] - 1e-9 for a, b in zip(got, expected, strict=True))


def test_filter_levels():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2))
    counts = np.r_[np.ones(len(pairs) - 100, np.int64), rng.integers(2, 10**6, 100)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([2], pa.int32()), pa.array([lm_scoring._pack(pairs, counts)], pa.binary())], ["shard", "kind", "run"])
    row = next(lm_scoring._merge(iter([batch]))).to_pylist()[0]
    part = lm_scoring.Part(0, {0: (0, len(row["filter"]))}, [row])
    levels = part.levels(pairs)
    exact_levels = np.floor(np.log2(counts)) + 1
    assert (levels >= exact_levels).all() and (levels == exact_levels).mean() > 0.97
    assert (part.levels(pairs + np.uint64(1)) > 0).mean() < 0.03


def test_no_training_and_no_rows(spark, empty):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    df = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scoring.lm_scores(df).collect()] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert lm_scoring.lm_scores(empty).count() == 0


def test_counts_beyond_a_byte(spark):
    text = " ".join(["one"] * 254 + ["two"] * 255 + ["three"] * 70_000 + ["four"])
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(40)]
    learnt, asked = held.index(False), held.index(True)
    docs = spark.createDataFrame([(learnt, text), (asked, "one two three four five")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}[asked]
    total = 254 + 255 + 70_000 + 2
    expected = sum(math.log10((c + 0.5) / (total + 0.5 * 6)) for c in (254, 255, 70_000, 1, 0, 1))
    assert (got.n_known, got.train_tokens) == (5, total) and got.base_score == pytest.approx(expected, rel=1e-12)


def test_shares_of_followers_sum_to_at_most_one():
    """Whatever the counts of a word's followers, their levels over the word's count are no more than a whole."""
    rng = np.random.default_rng(3)
    for counts in [np.full(50, k) for k in (1, 2, 3, 4, 7, 8, 15)] + [rng.integers(1, 10**6, 200)]:
        levels = np.floor(np.log2(counts)).astype(int) + 1
        share = lm_scoring._LEVEL[levels] / counts.sum()
        assert 0.5 <= share.sum() <= 1
