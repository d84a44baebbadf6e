import random
import zlib

import numpy as np
import pytest

from draftmill.llm import decontaminate, mixing, sharding, simhash, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_work_on_each_others_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
        if name != "sharding":
            assert docs.columns == columns
        if name in ("near_dedup", "decontamination"):
            assert docs.count() == docs.select("doc_id").distinct().count()
            assert docs.count() == docs.select("text").distinct().count() or name == "decontamination"
        if name == "decontamination":
            from draftmill.llm.decontaminate import contamination

            assert contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").count() == 0
    assert {r[0] for r in docs.select("shard").distinct().collect()} <= set(range(8))


def test_short_benchmark_items_are_cut(spark, tmp_path):
    spark.createDataFrame([(1, "what is the capital city")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(1, "one two three four five six What is the capital city? seven eight nine"), (2, "what is the capital of one two three four five")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert got[1].split() == "one two three four five six ? seven eight nine".split() and got[2] == texts[1][1]


# ---- each stage against a plain version, with null, empty, very long and repeated rows


@pytest.fixture(scope="module")
def world(spark, docs, records, tmp_path_factory):
    """The odd documents and 300 labelled ones, a third of them with insults, and tables of labels and benchmark items."""
    folder = tmp_path_factory.mktemp("world")
    rng = random.Random(2)
    plain = ["".join(rng.choice(["ka", "lo", "mi", "re", "tu"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for k in range(300):
        w = [rng.choice(plain) for _ in range(rng.randint(8, 50))]
        if k % 3 == 0:
            w[3:3] = ["grumbix", "snorfwat!"]
        rows.append((1000 + k, " ".join(w)))
    spark.createDataFrame([(i, int((i - 1000) % 3 == 0)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(rows[1][1].split()[:14])), (2, "one short item"), (3, None), (4, " ".join(next(t for i, t in records if i == 306).split()[100:130]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = [(2000, rows[1][1] + " one short item " + rows[2][1]), (2001, "One, short item!")]
    more = spark.createDataFrame([(i, t, "s2") for i, t in rows + extra], "doc_id long, text string, source string")
    every = docs.unionByName(more, allowMissingColumns=True)
    every.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), items, str(folder)


def keyed(df):
    return sorted(map(repr, df.select("doc_id", "text", "source").collect()))


def test_toxic_documents_go(spark, world):
    docs, _, folder = world
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    texts, toxic, share = toxicity.training_sample(docs, labels, 4, 2, "doc_id", "text", "toxic")
    assert len(texts) == sum(zlib.crc32(str(1000 + k).encode()) % 4 != 2 for k in range(300))
    machine = toxicity.fit(texts, toxic, share)
    judged = {t: machine.scores(np.array([toxicity.two_worst(machine.judge(toxicity.units(t)), machine.bias)]))[0] >= 0.3 for t in {r.text or "" for r in docs.select("text").collect()}}
    expected = sorted(repr(r) for r in docs.select("doc_id", "text", "source").collect() if not judged[r.text or ""])
    kept = pipeline.toxicity(spark, docs, folder)
    assert kept.columns == docs.columns and keyed(kept) == expected
    left = {r.doc_id for r in kept.collect()}
    assert sum(1000 + k in left for k in range(0, 300, 3)) <= 3 and sum(1000 + k in left for k in range(300) if k % 3) >= 195


def test_one_of_each_group_stays(spark, world):
    docs, _, folder = world
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    first = {}
    for i, t in texts:
        first[t] = min(i, first.get(t, i))
    sets = {i: simhash.shingle_hashes(t, 5) for t, i in first.items()}
    root = {i: i for i in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    for i in sets:
        for j in sets:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    stay = {i for i in sets if find(i) == i}
    got = pipeline.near_dedup(spark, docs, folder)
    assert got.columns == docs.columns
    assert keyed(got) == sorted(repr(r) for r in docs.select("doc_id", "text", "source").collect() if r.doc_id is None or r.doc_id in stay)


def test_benchmark_passages_go(spark, world):
    docs, items, folder = world
    windows = set()
    for _, t in items:
        w = decontaminate.normal_words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(0, len(w) - 9))} | ({tuple(w)} if 0 < len(w) < 10 else set())
    expected = []
    for r in docs.select("doc_id", "text", "source").collect():
        w = decontaminate.normal_words(r.text)
        hit = {k + j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if len(hit) > 0.5 * max(1, len(w)):
            continue
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((k, k + 1))
        expected.append(repr(r.__class__(doc_id=r.doc_id, text=decontaminate.without(r.text, spans) if spans else r.text, source=r.source)))
    got = pipeline.decontamination(spark, docs, folder)
    assert got.columns == docs.columns and keyed(got) == sorted(expected)
    assert 2001 not in {r.doc_id for r in got.collect()} and len(expected) < docs.count()


def test_sources_are_drawn_and_sharded(spark, world):
    docs, _, folder = world
    from test_mixing import draw

    mixed = pipeline.mixing(spark, docs, folder)
    rates = {r[0]: r[1] for r in mixing.source_rates(docs).collect()}
    assert mixed.columns == docs.columns
    assert keyed(mixed) == sorted(repr(r) for r in docs.select("doc_id", "text", "source").collect() for _ in range(draw(r.doc_id, rates[r.source])))
    got = pipeline.sharding(spark, docs, folder)
    assert keyed(got) == keyed(docs) and got.columns == [*docs.drop("shard").columns, "shard"]
    homes, load = {}, np.zeros(8)
    for r in got.collect():
        homes.setdefault(r.text or "", set()).add(r.shard)
        load[r.shard] += len((r.text or "").encode()) + 1
    largest = max(len((t or "").encode()) for t in homes)
    assert all(len(h) == 1 for h in homes.values()) and np.ptp(load) <= largest and sharding.SLOTS == 4096


def test_empty_tables_pass_through(spark, world):
    docs, _, folder = world
    now = docs.limit(0)
    for _, stage in pipeline.STAGES:
        now = stage(spark, now, folder)
        assert now.count() == 0


def test_run_leaves_its_results_alone(spark, world):
    docs, _, folder = world
    got = pipeline.run(spark, folder)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert got.columns == [*docs.drop("shard").columns, "shard"] and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    again = pipeline.run(spark, folder)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, again.collect()))
