import math
import random

import numpy as np
import pytest

from draftmill.llm import hard_negatives
from draftmill.llm.hard_negatives import BallTree, Search, mine_hard_negatives, needed

SCHEMA = "vec_id long, label int, embedding array<float>, id string, v string, part int, score string, place string, rank string"


def brute(records, every, positives, negatives, window, dim):
    good = lambda r: None not in r[:3] and len(r[2]) == dim and all(x is not None and math.isfinite(x) for x in r[2])
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in filter(good, records)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    anchors = {}
    for r in sorted(kept):
        if r[0] % every == 0:
            anchors.setdefault(r[0], r)
    out = []
    for i, lab, v in anchors.values():
        others = sorted((-dot(v, w), j, other) for j, other, w in kept if j != i)
        for s, j, _ in [r for r in others if r[2] == lab][:positives]:
            fit = [(t, m) for t, m, other in others if other != lab and window[0] * -s <= 100 * -t <= window[1] * -s]
            out += [(i, j, k + 1, m, -s, -t) for k, (t, m) in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    centers = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(6)]
    vec = lambda: [c + rng.gauss(0, 0.08) for c in rng.choice(centers)]
    out = [(k, rng.randrange(4), vec()) for k in range(700)]
    out += [(k, 1, out[20][2]) for k in range(800, 1000)]  # one vector many times
    out += [(k, k, vec()) for k in range(1000, 1040)]  # labels of their own
    out += [(20, 1, out[20][2]), (20, 0, out[20][2]), (33, 2, out[33][2]), (33, 2, out[33][2]), (40, 3, [0.0] * 8), (60, 77, vec())]
    out += [(None, 1, vec()), (2000, None, vec()), (2020, 1, None), (2040, 1, [0.1] * 7 + [None]), (2060, 2, [float("nan")] * 8), (2080, 2, [float("-inf")] * 8), (2100, 2, [0.5] * 4), (2120, 1, [])]
    return out


@pytest.fixture(scope="module")
def table(spark, records):
    return spark.createDataFrame([(*r, "x", "y", 1, "s", "p", "r") for r in records], SCHEMA).repartition(3)


@pytest.mark.parametrize(("window", "positives", "negatives"), [((30, 90), 5, 10), ((95, 100), 3, 4), ((0, 40), 400, 2)])
def test_equals_brute_force(table, records, rows, window, positives, negatives, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 300)  # several groups
    found = mine_hard_negatives(table, lambda i: i % 20 == 0, positives, negatives, window)
    assert rows(found) == brute(records, 20, positives, negatives, window, 8)


def tree_of(rng, n, spread):
    centers = rng.integers(-200, 200, (12, 16))
    rows = centers[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, (n, 16))
    return np.arange(n), rng.integers(0, 5, n), rows.astype(np.int64)


@pytest.mark.parametrize("large", [1, 10_000])
def test_bounds_prune_and_lose_nothing(large):
    rng = np.random.default_rng(2)
    ids, labels, rows = tree_of(rng, 6000, 4)
    rows *= large  # products beyond what doubles hold exactly
    tree = BallTree(ids, labels, rows, leaf=64)
    anchors = np.arange(0, 6000, 300)
    for same, low, high in [(True, -(2**62), 2**62), (False, 30, 90)]:
        own = (rows[anchors] ** 2).sum(1)
        s = Search(np.arange(len(anchors)), same, np.full(len(anchors), low) if same else low * own, np.full(len(anchors), high) if same else high * own, 5)
        tree.search(rows[anchors], labels[anchors], anchors, s)
        for k, a in enumerate(anchors):
            score = rows @ rows[a]
            fits = (ids != a) & ((labels == labels[a]) == same) & (100 * score >= s.low[k]) & (100 * score <= s.high[k])
            best = sorted(zip((-score[fits]).tolist(), ids[fits].tolist(), strict=True))[:5]
            mine = s.query == k
            assert sorted(zip((-s.score[mine]).tolist(), s.id[mine].tolist(), strict=True)) == best
        assert s.visited < s.leaves / 3


def test_only_rows_that_ids_rule_out_are_left_out():
    ids = np.array([5, 1, 1, 1, 2, 3, 4, 9, 9])
    labels, rows = np.zeros(9, np.int64), np.ones((9, 2), np.int64)
    assert ids[needed(ids, labels, rows, 2)].tolist() == [1, 1, 1, 2, 3]
    labels[6:] = 1
    assert needed(ids, labels, rows, 2).sum() == 5 + 3
    assert len(needed(ids[:0], labels[:0], rows[:0], 2)) == 0


def test_no_rows(table):
    assert mine_hard_negatives(table.limit(0), lambda i: i % 20 == 0).count() == 0
    assert mine_hard_negatives(table, lambda i: i < 0).count() == 0
