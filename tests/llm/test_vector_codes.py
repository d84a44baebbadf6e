import hashlib
import math
import random

import numpy as np
import pytest

from draftmill.llm import vector_codes
from draftmill.llm.vector_codes import PartialDistances, compress_vectors, encode_vectors, fit_codebooks

SCHEMA = "vec_id long, label int, embedding array<float>, id string, code string, error int, label_error int, v int, own int"


def brute(records, parts, entries, rounds, dim):
    """(id, code, error, label_error, digest) by plain loops."""
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, lab, v) for i, lab, v in records if good(v)]
    first = min(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in kept if len(v) == len(first[2])]
    w = -(-dim // parts)
    cut = lambda v: [tuple((v + [0] * (parts * w - dim))[p * w : (p + 1) * w]) for p in range(parts)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[p] for _, _, v in ordered] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((dist(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            mine: dict[int, list] = {}
            for _, _, v in kept:
                mine.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            for k, xs in mine.items():
                new[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    rows = []
    for i, lab, v in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        rows.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total: dict = {}
    for _, lab, _, e in rows:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, total[lab], digest) for i, lab, c, e in rows), key=repr)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(7)
    vec = lambda: [rng.choice([rng.gauss(0, 0.3), 0.0, 0.25]) for _ in range(10)]
    out = [(k, rng.choice([1, 2, 3, None]), vec()) for k in range(160)]
    out += [(k, 1, out[3][2]) for k in range(200, 230)]
    out += [(3, 1, out[3][2]), (3, 1, out[3][2]), (None, 2, vec()), (-5, None, vec()), (400, 1, None), (401, 2, [0.1] * 9 + [None]), (402, 2, [float("nan")] * 10), (403, 2, [float("inf")] * 10), (404, 2, [1.0] * 4), (405, 2, [])]
    return out


@pytest.fixture(scope="module")
def table(spark, records):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4) for r in records], "vec_id long, label int, embedding array<float>, id string, code string, error int, label_error int, v int, own int").repartition(3)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(5, 16, 2), (4, 200, 1), (16, 8, 0)])
def test_equals_brute_force(table, records, rows, parts, entries, rounds):
    assert rows(compress_vectors(table, parts, entries, rounds)) == brute(records, parts, entries, rounds, 10)


def test_many_labels_are_joined_by_shuffle(table, records, rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    found = compress_vectors(table, 5, 16, 1)
    assert rows(found) == brute(records, 5, 16, 1, 10)


def test_partial_distances_skip_and_keep_the_nearest():
    rng = np.random.default_rng(1)
    entries = rng.integers(-6, 6, (64, 6)) * np.array([1, 9, 2, 30, 1, 1])
    x = np.concatenate([rng.integers(-6, 6, (5000, 6)) * np.array([1, 9, 2, 30, 1, 1]), entries])
    search = PartialDistances(entries)
    assert search.order[0] == 3
    index, distance = search.nearest(x)
    every = ((x[:, None] - entries) ** 2).sum(2)
    assert np.array_equal(index, every.argmin(1)) and np.array_equal(distance, every.min(1))
    assert search.compared < search.possible / 2


def test_codes_stand_for_near_vectors(table):
    books = fit_codebooks(table, 5, 64, 2)
    row = encode_vectors(table, books).filter("vec_id = 17").first()
    codes = np.array([[int(row.code[k : k + 2], 16) for k in range(0, 10, 2)]])
    own = np.floor(256 * np.array(table.filter("vec_id = 17").first().embedding)).astype(np.int64)
    assert ((books.decoded(codes)[0] - own) ** 2).sum() == row.error


def test_no_rows(table):
    assert compress_vectors(table.limit(0)).count() == 0
    assert compress_vectors(table.filter("embedding is null")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
