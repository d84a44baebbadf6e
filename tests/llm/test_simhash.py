import random

import numpy as np
import pytest
import xxhash

from draftmill.llm import simhash


def naive(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(pairs, radius):
    """(id -> component) by comparing all with all."""
    root = {i: i for i, _ in pairs}
    find = lambda k: k if root[k] == k else find(root[k])
    for i, f in pairs:
        for j, g in pairs:
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in pairs}


def test_equals_brute_force(docs, records, rows):
    prints = {(i, t): naive(t) for i, t in records}
    group = components([(i, f) for (i, _), f in prints.items() if i is not None], 3)
    expected = sorted(((i, "%016x" % prints[i, t], group.get(i)) for i, t in records), key=repr)
    assert rows(simhash.simhash_components(docs)) == expected


@pytest.mark.parametrize(("radius", "n"), [(3, 300), (3, 10**8), (7, 10**6), (14, 10**6)])
def test_plans_miss_no_near_pair(radius, n):
    bits = 128 if radius > 7 else 64
    rng = np.random.default_rng(radius)
    common = rng.random(bits)
    sample = rng.random((400, bits)) < common
    plan = simhash.plan_partitions(n, (sample.T.astype(float) @ sample) * n / 400, radius)
    assert sum(t + 1 for _, t in plan) == radius + 1
    assert len({k for part, _ in plan for k in part}) == sum(len(part) for part, _ in plan)
    masks = simhash.masks_of(plan, bits // 64)
    fps = np.packbits(sample, axis=1, bitorder="little").view(np.uint64)
    for _ in range(50):
        flips = np.zeros(bits, np.uint8)
        flips[rng.choice(bits, rng.integers(0, radius + 1), replace=False)] = 1
        near = fps[:1] ^ np.packbits(flips, bitorder="little").view(np.uint64)
        assert any(simhash._keys(fps[:1], m, k) == simhash._keys(near, m, k) for k, m in enumerate(masks))


@pytest.mark.parametrize("size", [10, 200])  # small buckets by offset, large ones by forest
def test_bucket_links_connect_what_is_near(size):
    rng = random.Random(size)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    values = list(dict.fromkeys(rng.choice(seeds) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(size)))
    fps = np.array(values, np.uint64).reshape(-1, 1)
    root = {v: v for v in values}
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in simhash.bucket_links(fps, np.zeros(len(fps), np.uint64), simhash.within(3)):
        for x, y in zip(a[:, 0].tolist(), b[:, 0].tolist(), strict=True):
            assert (x ^ y).bit_count() <= 3
            p, q = sorted((find(x), find(y)))
            root[q] = p
    expected = components([(v, v) for v in values], 3)
    assert {v: find(v) for v in values} == expected


def greedy(records, similarity=0.8):
    """Ids that stay: first of equal texts, then by ascending id unless similar to one kept."""
    first = {}
    for i, t in records:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    kept = []
    for i, t in sorted((i, t) for t, i in first.items()):
        own = simhash.shingle_hashes(t, 5)
        if all(len(own & o) < similarity * len(own | o) for _, o in kept):
            kept.append((i, own))
    return {i for i, _ in kept}


@pytest.mark.parametrize("part", [2000, 2])
def test_one_of_each_group_stays(docs, records, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    stay = greedy(records)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in got.select("doc_id").collect()))) == sorted(repr(i) for i, _ in records if i is None or i in stay)


def test_no_rows(empty):
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_texts_cut_short_or_added_to_are_found(spark):
    rng = random.Random(3)
    new = lambda n: ["w" + str(rng.randrange(10**6)) for _ in range(n)]
    records = []
    for k in range(0, 600, 10):
        w = new(200)
        # Cut at the end, at the start, in the middle; added to at the end, in the middle; all of Jaccard 0.8 to 0.84.
        records += [(k + j, " ".join(x)) for j, x in enumerate([w, w[:165], w[35:], w[:80] + w[112:], w + new(42), w[:90] + new(38) + w[90:]])]
    originals = {i for i, _ in records if i % 10 == 0}
    sets = {i: simhash.shingle_hashes(t, 5) for i, t in records}
    near = {i for i in sets if len(sets[i] & sets[i // 10 * 10]) >= 0.8 * len(sets[i] | sets[i // 10 * 10])}
    assert len(near) == len(records)
    stay = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(records, "doc_id long, text string").repartition(3)).collect()}
    assert stay == originals


def connected(records, similarity=0.8):
    """Ids that stay: the smallest of each component of similar texts, by comparing all with all."""
    sets = {i: simhash.shingle_hashes(t, 5) for i, t in records}
    root = {i: i for i in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    for i, own in sets.items():
        for j, other in sets.items():
            if len(own & other) >= similarity * len(own | other):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


@pytest.mark.parametrize("part", [2000, 2])
def test_links_by_way_of_dropped_texts_count(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(9)
    new = lambda n: ["w" + str(rng.randrange(10**6)) for _ in range(n)]
    records = []
    for k in range(0, 400, 10):
        w = new(200)
        a, b = w[:170], w[30:]  # both similar to w, not to each other
        records += [(k + 1, " ".join(a)), (k + 2, " ".join(w)), (k + 3, " ".join(b)), (k + 4, " ".join(new(80)))]
        for j in range(5, 9):
            x = w[:]
            for _ in range(3):
                x[rng.randrange(200)] = new(1)[0]
            records.append((k + j, " ".join(x)))
    expected = connected(records)
    assert len(greedy(records)) > len(expected) == 80
    got = simhash.drop_near_duplicates(spark.createDataFrame(records, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in got.collect()} == expected


def test_unlike_texts_that_share_bands_form_no_chain(spark):
    rng = random.Random(11)
    new = lambda n: ["w" + str(rng.randrange(10**6)) for _ in range(n)]
    common = new(60)
    # Each two share a third of their shingles: many share a band, none is similar.
    records = [(k, " ".join(common + new(50))) for k in range(300)]
    sets = [simhash.shingle_hashes(t, 5) for _, t in records]
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    keys = simhash.band_keys(np.concatenate([np.fromiter(s, np.uint64, len(s)) for s in sets]), starts, *simhash.tune_bands(0.8))
    assert sum(len(np.unique(band)) for band in keys) < keys.size - 300  # bands in common
    source = spark.createDataFrame(records, "id long, text string").repartition(3)
    assert simhash.shingle_links(source, 5, 0.8).count() < 10
    assert simhash.drop_near_duplicates(source, id_col="id").count() == 300


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_sketches_keep_similar_pairs(similarity):
    rng = np.random.default_rng(2)
    least = simhash.least_agreement(similarity)
    both = 190
    apart = round(both * (1 / similarity - 1) / 2)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, both + 2 * apart, np.uint64)
        a, b = x[: both + apart], np.r_[x[:both], x[both + apart :]]
        prints = simhash.sketches(np.r_[a, b], np.array([0, len(a)]))
        agreed = int(simhash.agreement(prints[0], prints[1]))
        values = [int(np.min(a * o) & np.uint64(15)) == int(np.min(b * o) & np.uint64(15)) for o in simhash._ODD[: simhash.SKETCH]]
        assert agreed == sum(values) and agreed >= least


def test_wide_records_make_fewer_signatures_and_sketches_are_asked_of_near_prints():
    """Pipeline, disk of near_dedup: a signature cost the same whether one word was shuffled for it or six."""
    both = np.full((128, 128), 0.25)
    np.fill_diagonal(both, 0.5)
    n = 230_000
    narrow, wide = (len(simhash.masks_of(simhash.plan_partitions(n, both * n, 14, words=w), 2)) for w in (1, 6))
    assert 2 * wide < narrow
    plan = simhash.plan_partitions(n, both * n, 14, words=6)
    assert sum(t + 1 for _, t in plan) >= 15 and len({k for part, _ in plan for k in part}) == sum(len(part) for part, _ in plan)
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, (400, 6)).astype(np.uint64)
    b = a ^ np.where(r.random((400, 6)) < 0.5, np.uint64(0), np.uint64(0x8421) << r.integers(0, 40, (400, 6)).astype(np.uint64))
    close = simhash.within_and_alike(6, 2, 50)
    plain = (simhash._distance(a[:, :2], b[:, :2]) <= 6) & (simhash.agreement(a[:, 2:], b[:, 2:]) >= 50)
    assert 0 < plain.sum() < 400 and np.array_equal(close(a, b), plain)
    assert np.array_equal(close(a, a[7]), np.arange(400) == 7)
