"""Search, structure and the rule store against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.functions import text as tx
from draftmill.operators import rules, structure, vector


def vectors(spark, matrix):
    return spark.createDataFrame([(k, f"l{k}", [float(x) for x in row]) for k, row in enumerate(matrix)], "id long, label string, embedding array<float>")


@pytest.mark.parametrize("block", [4096, 2])
def test_nearest_equals_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK", block)
    m = np.random.default_rng(1).normal(size=(40, 6)).astype(np.float32)
    m[7] = m[3]  # a tie
    got = {(r.query_id, r.rank): (r.rule_id, r.distance) for r in vector.nearest(vectors(spark, m[:5]), vectors(spark, m), 4).collect()}
    for q in range(5):
        d = np.sqrt(((m[q].astype(float) - m.astype(float)) ** 2).sum(1))
        for rank, k in enumerate(np.lexsort((np.arange(40), d))[:4], 1):
            assert got[q, rank][0] == k and got[q, rank][1] == pytest.approx(d[k])


def test_nearest_gives_fewer_rows_than_k(spark):
    m = np.eye(3)
    assert vector.nearest(vectors(spark, m), vectors(spark, m[:2]), 5).count() == 6
    assert vector.nearest(vectors(spark, m), vectors(spark, m).limit(0), 5).count() == 0
    assert vector.nearest(vectors(spark, m).limit(0), vectors(spark, m), 5).count() == 0


def test_components_are_centered(spark):
    m = np.random.default_rng(2).normal(size=(30, 5)) + 9
    got = np.array([[r.pc1, r.pc2] for r in vector.principal_components(vectors(spark, m)).orderBy("id").collect()])
    centered = m.astype(np.float32).astype(float) - m.astype(np.float32).astype(float).mean(0)
    u, s, _ = np.linalg.svd(centered, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-5)
    assert vector.principal_components(vectors(spark, m[:2])).count() == 0


def test_shift_match_finds_the_shift():
    rng = np.random.default_rng(3)
    raw = rng.random((9, 9, 4))
    feature = lambda a: (a / (np.linalg.norm(a, axis=-1, keepdims=True) + 1e-6), a.sum(-1))
    fa, ea = feature(raw[2:8, 2:8])
    fb, eb = feature(raw[1:7, 3:9])
    best = lambda *x: tuple(v[0] for v in structure.shift_scores(*[a[None] for a in x]))
    assert best(fa, ea, fa, ea) == (pytest.approx(1, abs=1e-4), 0, 0)
    score, dy, dx = best(fa, ea, fb, eb)
    assert (dy, dx) == (-1, 1) or (dy, dx) == (1, -1)
    similar = structure.similarity_map(fa, ea, fb, eb, dy, dx)
    assert score == pytest.approx(1, abs=1e-4) and similar.shape == (5, 5)
    assert best(fa, np.zeros_like(ea), fb, eb) == (0.0, -2, -2)


@pytest.mark.parametrize("weighed", [True, False])
def test_matches_with_and_without_energies(spark, weighed):
    rng = np.random.default_rng(6)
    f, e = rng.random((6, 4, 5, 3)), rng.random((6, 4, 5))
    rows = [(k, f[k].ravel().tolist(), e[k].ravel().tolist() if weighed or k > 2 else None) for k in range(6)] + [(9, None, None)]
    described = spark.createDataFrame(rows, "id long, features array<double>, energies array<double>")
    pairs = spark.createDataFrame([(a, b) for a in (0, 3, 5, 9) for b in range(6)], "query_id long, rule_id long")
    found = {(r.query_id, r.rule_id): (r.structure, r.dy, r.dx) for r in structure.match_structure(pairs, described, 5, 4, 3).collect()}
    assert len(found) == 18
    for (a, b), (score, *shift) in found.items():
        plain = not weighed and min(a, b) <= 2
        every = []
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                cells = [(y, x, y - dy, x - dx) for y in range(4) for x in range(5) if 0 <= y - dy < 4 and 0 <= x - dx < 5]
                s = [f[a, y, x] @ f[b, v, u] for y, x, v, u in cells]
                w = [1.0 if plain else min(e[a, y, x], e[b, v, u]) for y, x, v, u in cells]
                used = [(p, q) for p, q in zip(s, w, strict=True) if q > 1e-4]
                every.append((-round(sum(p * q for p, q in used) / (sum(q for _, q in used) + (0 if plain else 1e-6)), 9), dy, dx))
        assert (-round(score, 9), *shift) == min(every)
    if not weighed:
        no_column = {(r.query_id, r.rule_id): (r.structure, r.dy, r.dx) for r in structure.match_structure(pairs, described.drop("energies"), 5, 4, 3).collect()}
        assert no_column[0, 1] == found[0, 1]


def clustered(rng, n):
    return np.repeat(rng.normal(size=(10, 6)) * 20, n // 10, axis=0) + rng.normal(size=(n, 6))


@pytest.mark.parametrize("group", [65_536, 7])
def test_filed_rules_give_what_nearest_gives(spark, group):
    rng = np.random.default_rng(7)
    m = np.round(clustered(rng, 300), 1)  # with ties
    m[50:90] = m[50]
    rows = [(k, "l", v.tolist()) for k, v in enumerate(m)] + [(5, "again", m[5].tolist()), (None, "x", m[0].tolist()), (900, "y", None)]
    store = spark.createDataFrame(rows, "id long, label string, embedding array<double>")
    queries = spark.createDataFrame([(k, "q", (v + rng.normal(size=6) * 0.1).tolist()) for k, v in enumerate(m[::9])] + [(77, "q", [0.0] * 6)], store.schema)
    key = lambda df: sorted((r.query_id, r.rank, r.rule_id, round(r.distance, 9)) for r in df.collect())
    filed = vector.FiledRules(store, 12, group=group)
    for k in (1, 4, 500):
        assert key(filed.nearest(queries, k)) == key(vector.nearest(queries, store, k))


def test_filed_rules_skip_groups(spark):
    m = clustered(np.random.default_rng(8), 400)
    store = vectors(spark, m)
    filed = vector.FiledRules(store, 20)
    asked = store.filter("id % 10 = 0").select("id", vector.F.col("embedding").cast("array<double>").alias("v"))
    near = vector._ranked(filed._searched(filed._sent(asked.withColumn("bound", vector.F.lit(None)), 3, True), 3), 3)
    sent = sum(len(r.ids) // 8 for r in filed.others(asked, near, 3).collect())
    assert sent < 0.25 * 40 * int((filed.count > 0).sum())  # of all pairs of query and group
    assert vector.FiledRules(store.limit(0)).nearest(store, 3).count() == 0
    assert filed.nearest(store.limit(0), 3).count() == 0


def test_batches_of_pairs_equal_each_pair():
    rng = np.random.default_rng(5)
    fa, fb, ea, eb = rng.random((7, 4, 5, 3)), rng.random((7, 4, 5, 3)), rng.random((7, 4, 5)) * 2e-4, rng.random((7, 4, 5)) * 2e-4
    got = structure.shift_scores(fa, ea, fb, eb)
    for p in range(7):
        expected = (-1.0, 0, 0)
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                cells = [(y, x) for y in range(4) for x in range(5) if 0 <= y - dy < 4 and 0 <= x - dx < 5]
                used = [(fa[p, y, x] @ fb[p, y - dy, x - dx], min(ea[p, y, x], eb[p, y - dy, x - dx])) for y, x in cells]
                used = [(s, w) for s, w in used if w > 1e-4]
                score = sum(s * w for s, w in used) / (sum(w for _, w in used) + 1e-6) if used else 0.0
                if round(score, 9) > round(expected[0], 9):
                    expected = (score, dy, dx)
        assert (got[0][p], got[1][p], got[2][p]) == (pytest.approx(expected[0]), *expected[1:])


def test_descriptor_of_a_blank_image_keeps_large_border_cells():
    unit, energy = structure.grid_descriptor(np.full((512, 192), 255.0))
    assert energy[0, 0] == pytest.approx(9.0e-5) and not unit[0, 0].any()
    assert energy[0, 19] == pytest.approx(2.10e-4) and energy[49, 0] == pytest.approx(1.98e-4) and energy[49, 19] == pytest.approx(4.62e-4)
    assert unit[49, 19].argmax() == 4


def test_scores(spark):
    df = spark.createDataFrame([(0.3, 0.6), (1.2, 0.59999)], "blended double, structure double")
    assert [(round(r.final_score, 6), r.trusted) for r in vector.match_scores(df).collect()] == [(70.0, True), (0.0, False)]


def test_rule_store(spark, tmp_path):
    store = rules.RuleStore(spark, str(tmp_path / "rules"))
    assert store.rules().count() == 0
    batch = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0]), (2, "a", [3.0]), (3, None, [4.0])], "position int, label string, embedding array<float>")
    assert sorted((r.label or "", r.added) for r in store.add(batch).collect()) == [("", False), ("a", False), ("a", True), ("b", True)]
    more = spark.createDataFrame([(0, "b", [9.0]), (1, "c", [5.0])], "position int, label string, embedding array<float>")
    assert sorted((r.label, r.added) for r in store.add(more).collect()) == [("b", False), ("c", True)]
    assert [(r.id, r.label, r.dim) for r in store.listing().collect()] == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
    assert store.get(2).first().label == "b" and store.get(9).first() is None
    assert store.dump().first().line == "id=0001 label=a embedding=[1.0000] (dim=1)"
    assert "<td>1</td>" in store.dump(html=True).first().line
    store.add(more, unless_present=False)
    assert store.rules().count() == 5
    store.clear()
    assert store.rules().count() == 0


def test_columns_added_to_a_store(spark, tmp_path):
    store = rules.RuleStore(spark, str(tmp_path / "rules"))
    store.set_columns("id long, label string, embedding array<float>")
    old = spark.createDataFrame([(0, "old", [1.0, 0.0])], "position int, label string, embedding array<float>")
    store.add(old)
    assert store.rules().columns == ["id", "label", "embedding"]
    store.add_columns("features array<double>, energies array<double>, note string")
    store.add_columns("note string")  # is there
    with pytest.raises(ValueError, match="note is there"):
        store.add_columns("note int")
    with pytest.raises(ValueError, match="holds rows"):
        store.set_columns("id long, label string, embedding array<float>")
    new = spark.createDataFrame([(0, "new", [0.9, 0.1], [1.0, 0.0], [1.0], "n", 1), (1, "old", [0.9, 0.1], [1.0, 0.0], [1.0], "n", 1)], "position int, label string, embedding array<float>, features array<double>, energies array<double>, note string, other int")
    store.add(new)
    assert [(r.id, r.label, r.features, r.note) for r in store.rules().orderBy("id").collect()] == [(1, "old", None, None), (2, "new", [1.0, 0.0], "n")]
    queries = spark.createDataFrame([(7, [1.0, 0.0], [1.0, 0.0], [1.0])], "id long, embedding array<float>, features array<double>, energies array<double>")
    assert [r.rule_id for r in structure.recognise(queries, store.rules(), 3, 1, 1, 2).collect()] == [2]  # the old row has nothing to match
    store.clear()
    assert store.rules().count() == 0 and "note" in store.rules().columns


def test_writers_that_meet(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    batch = spark.createDataFrame([(k, f"l{k % 3}", [float(k)]) for k in range(6)], "position int, label string, embedding array<float>")
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda _: sorted((r.label, r.added) for r in rules.RuleStore(spark, str(tmp_path / "rules")).add(batch).collect()), range(4)))
    found = rules.RuleStore(spark, str(tmp_path / "rules")).rules().orderBy("id").collect()
    assert [(r.id, r.label) for r in found] == [(1, "l0"), (2, "l1"), (3, "l2")]
    assert sum(a for one in added for _, a in one) == 3


def test_numbers_that_were_given_up(spark, tmp_path):
    store = rules.RuleStore(spark, str(tmp_path / "rules"))
    store.patience = 0.2
    batch = spark.createDataFrame([(0, "a", [1.0])], "position int, label string, embedding array<float>")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "v00000000.taken").touch()  # a writer that was lost
    store.add(batch)
    assert [(r.id, r.label) for r in store.rules().collect()] == [(1, "a")]


def test_negative_zeros_keep_their_sign(spark):
    """-0.00001 to four digits is -0.0000, as in SQL."""
    row = spark.createDataFrame([(1, "a", [-0.00001, 0.00001, -0.0, -0.25, 3.0])], "id long, label string, v array<float>")
    line, values = row.select(tx.rule_line("id", "label", "v"), F.transform("v", lambda x: tx.rounded(x, 4)).cast("string")).first()
    assert line == "id=0001 label=a embedding=[-0.0000, 0.0000, -0.0000, -0.2500, 3.0000] (dim=5)"
    assert values == "[-0.0, 0.0, -0.0, -0.25, 3.0]"


def test_groups_are_few_where_many_rows_a_query_go_on():
    """F2, F8: there were as many groups as shuffle partitions, each of which sent on k rows a query."""
    assert vector.dealing(100_000, 100_000, 512, 91, 100)[0] <= 8
    assert vector.dealing(5_000, 100_000, 512, 5, 48)[0] > 16
    groups, shares = vector.dealing(600_000, 6_000_000, 512, 2, 48)
    assert 6_000_000 / groups <= vector.GROUP and groups * shares >= 48


@pytest.mark.parametrize("k", [1, 91])
def test_products_find_what_differences_find(k):
    """F8: ties, copies, few distinct values and large offsets."""
    g = np.random.default_rng(4)
    m = g.normal(size=(6000, 16)).astype(np.float32).astype(float)
    m[50:200] = m[7]
    ids = g.permutation(6000)
    for rules in (m, np.round(m), m + 1e4):
        _, r, d = (np.concatenate(x) for x in zip(*vector._best_of(k)(ids[:300], rules[:300], ids, rules), strict=True))
        far = vector.distances(rules[:300], rules)
        order = np.lexsort((np.tile(ids, (300, 1)), far), axis=1)[:, :k]
        assert (r == ids[order].ravel()).all()
        assert np.allclose(d, np.take_along_axis(far, order, 1).ravel(), rtol=1e-12)


def test_search_memory_does_not_grow_with_the_group():
    """a task held blocks of 4,000,000 distances several times over, and groups of any number of bytes."""
    import tracemalloc

    r = np.random.default_rng(8)
    ids, own = np.arange(1024), r.normal(size=(1024, 8))
    peaks = []
    for n in (8_000, 64_000):
        matrix = r.normal(size=(n, 8))
        tracemalloc.start()
        found = [x for x in vector._best_of(5)(ids, own, np.arange(n), matrix)]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sum(len(q) for q, _, _ in found) == 5 * 1024
    assert peaks[1] < 60 << 20
    for width in (8, 512, 100_000):
        groups, _ = vector.dealing(1000, 1_000_000, width, 5, 12)
        assert 1_000_000 / groups * width <= vector.GROUP_BYTES


def test_vectors_of_unequal_lengths_are_refused():
    import pyarrow as pa

    whole = pa.array([[1.0, None], [3, 4], [5, 6]], pa.list_(pa.float32()))
    assert np.array_equal(vector._matrix(whole.slice(1, 2)), [[3, 4], [5, 6]])
    assert np.isnan(vector._matrix(whole)[0, 1])
    with pytest.raises(ValueError):
        vector._matrix(pa.array([[1.0], [1.0, 2.0, 3.0]]))


def test_rows_of_all_pairs_store_their_ids_in_little_room(spark, tmp_path):
    """rules came in one long run a query, so their ids took 1.5 bytes a row of the matrix at 51,282 vectors."""
    import pyarrow.parquet as pq

    rules = spark.range(40_000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("embedding"))
    vector.distance_rows(rules.filter("id < 30"), rules).write.parquet(str(tmp_path / "rows"))
    bytes_of, rows = {}, 0
    for f in (tmp_path / "rows").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        rows += meta.num_rows
        for g in range(meta.num_row_groups):
            for c in map(meta.row_group(g).column, range(3)):
                bytes_of[c.path_in_schema] = bytes_of.get(c.path_in_schema, 0) + c.total_compressed_size
    assert rows == 1_200_000
    assert bytes_of["query_id"] + bytes_of["rule_id"] < 0.5 * rows


@pytest.mark.parametrize("tile, cells", [(128, 1_000_000), (7, 500), (1, 1)])
def test_rows_of_all_pairs_are_whole(spark, monkeypatch, tile, cells):
    """tiles that don't divide the rules, single rows, repeated ids."""
    monkeypatch.setattr(vector, "TILE", tile, raising=False)
    monkeypatch.setattr(vector, "CELLS", cells)
    m = np.random.default_rng(10).normal(size=(61, 5)).astype(np.float32)
    rules = vectors(spark, m).unionByName(vectors(spark, m[:3]))
    got = sorted(tuple(r) for r in vector.distance_rows(vectors(spark, m[:9]), rules).collect())
    want = sorted((q, r, float(np.sqrt(((m[q].astype(float) - m[r].astype(float)) ** 2).sum()))) for q in range(9) for r in [*range(61), 0, 1, 2])
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-12, atol=1e-12)


def test_each_group_and_share_is_a_task_of_its_own(spark):
    """parts were dealt by the hash of their number, so 12 of them met in 7 tasks."""
    m = np.random.default_rng(11).normal(size=(400, 4))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = vector.distance_rows(vectors(spark, m[:100]), vectors(spark, m))
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups, shares = vector.dealing(100, 400, 32, 0, 12)
    assert len(tasks) == groups * shares and sum(r[1] for r in tasks) == 40_000


def test_rounded_rows_of_all_pairs_store_their_distances_in_little_room(spark, tmp_path):
    """a row's distance took 8 bytes, as rows of one file had distances of every size."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from draftmill.plans.queries import QUERIES

    m = np.random.default_rng(12).normal(size=(10_000, 32))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(10_000), "embedding": pa.array(list(m)), "label": np.zeros(10_000, np.int32)}), tmp_path / "embeddings.parquet")
    QUERIES["q02_distance_matrix"](spark, str(tmp_path)).write.parquet(str(tmp_path / "rows"))
    files = list((tmp_path / "rows").glob("*.parquet"))
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 5_000_000
    assert sum(f.stat().st_size for f in files) < 5.5 * 5_000_000
    few = spark.read.parquet(str(tmp_path / "rows")).filter("query in ('[Q] 0', '[Q] 9980')").collect()
    want = {(f"[Q] {q}", str(r)): d for q in (0, 9980) for r, d in enumerate(np.sqrt(((m[q].astype(float) - m.astype(float)) ** 2).sum(1)))}
    assert len(few) == len(want) and all(abs(r.distance - want[r.query, r.rule]) <= 5.01e-7 and r.distance == round(r.distance, 6) for r in few)


def _rounded_pairs(a, b, digits):
    """Distances from differences, in units, halves upwards."""
    with np.errstate(all="ignore"):
        at = np.sqrt(((a[:, None].astype(float) - b[None]) ** 2).sum(2)) * 10.0**digits
    return np.floor(at) + (at - np.floor(at) >= 0.5)


@pytest.mark.parametrize("digits", [1, 3, 6])
def test_each_pair_is_in_one_band_with_the_last_digit_right(digits):
    """products of matrices alone are wrong for near vectors and where a distance lies between two roundings."""
    r = np.random.default_rng(13)
    rules = np.concatenate([r.integers(-8, 8, (200, 3)) / 4, r.normal(size=(200, 3)), 1e3 + 1e-6 * r.normal(size=(50, 3))])
    own = np.concatenate([rules[::7], rules[:5] + 1e-7])
    ids, rule_ids, want = 1000 + np.arange(len(own)), np.arange(len(rules)), _rounded_pairs(own, rules, digits)
    edges = np.quantile(want, [0.1, 0.3, 0.5, 0.9]).round().tolist()
    bands = [vector._banded(a, b, digits) for a, b in zip(edges, edges[1:])] + [vector._banded(edges[0], edges[-1], digits, outside=True)]
    got = [tuple(np.concatenate(x) for x in zip(*band(ids, own, rule_ids, rules), strict=True)) for band in bands]
    assert [len(q) for q, _, _ in got] == [((want >= a) & (want < b)).sum() for a, b in zip(edges, edges[1:])] + [((want < edges[0]) | (want >= edges[-1])).sum()]
    q, s, d = (np.concatenate(x) for x in zip(*got, strict=True))
    assert len(set(zip(q, s))) == want.size
    assert (d == want[q - 1000, s] / 10.0**digits).all()


def test_banded_rows_of_all_pairs_are_whole(spark, monkeypatch):
    """repeated and text ids, no numbers, infinite and huge ones; several groups, shares and blocks."""
    monkeypatch.setattr(vector, "BANDED", 1)
    monkeypatch.setattr(vector, "STRIDE", 500)
    monkeypatch.setattr(vector, "TOGETHER", 20)
    monkeypatch.setattr(vector, "CELLS", 300)
    monkeypatch.setattr(vector, "NAMES_BYTES", 150)
    m = np.random.default_rng(14).normal(size=(60, 5)).astype(np.float32)
    m[7], m[20] = m[3], m[21] + 1e-6
    named = vectors(spark, m).withColumn("id", F.concat(F.lit("r'\n"), "id"))
    for odd in (None, np.nan, np.inf, 1e30):
        if odd is not None:
            m[11, 2] = odd
        rules = vectors(spark, m).unionByName(vectors(spark, m[:3]))
        found = vector.distance_rows(vectors(spark, m[:13]), rules, digits=3)
        assert (found.rdd.getNumPartitions() > 20) == (odd != 1e30)  # so far apart that no bands are made
        want = _rounded_pairs(m[:13], m, 3)
        wanted = sorted((q, r, want[q, r]) for q in range(13) for r in [*range(60), 0, 1, 2])
        got = sorted(tuple(x) for x in found.collect())
        assert [x[:2] for x in got] == [x[:2] for x in wanted]
        assert np.allclose([x[2] for x in got], [x[2] / 1000 for x in wanted], rtol=1e-12, atol=0, equal_nan=True)
    got = vector.distance_rows(vectors(spark, m[:9]), named, digits=3)
    assert got.dtypes == [("query_id", "bigint"), ("rule_id", "string"), ("distance", "double")]
    assert sorted((x[0], x[1]) for x in got.collect()) == sorted((q, f"r'\n{r}") for q in range(9) for r in range(60))


def test_bands_are_few_and_none_where_distances_are_far_apart():
    r = np.random.default_rng(15)
    edges = vector._edges(r.normal(1.4e6, 9e4, 65_536))
    assert 5 < len(edges) < 20 and (np.diff(edges) <= vector.STRIDE * vector.STRIDES).all()
    assert vector._edges(r.uniform(0, 1e9, 65_536)) == vector._edges(np.array([np.nan, np.inf])) == []
