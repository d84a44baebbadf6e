import random
import zlib

import numpy as np
import pytest

from draftmill.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "re", "tu", "sen", "or", "pa", "di"]
    plain = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    insults = ["grumbix", "snorfwat", "blexhead"]
    rows, labels = [], []
    for k in range(700):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = k % 4 == 0
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "!", "en", "ly"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    rows, labels, docs, table = labelled
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, table).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sorted(k for k, r in got.items() if r.held_out) == held
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    clean = toxicity.drop_toxic(docs, table)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if not r.predicted}


def test_disguised_insults_score_higher_than_clean_words(labelled):
    rows, labels, _, _ = labelled
    machine = toxicity.fit([t for _, t in rows], [bool(y) for _, y in labels])
    clean = max(machine.judge(["kalomi", "sentu", "diorpa"]))
    assert min(machine.judge(["grumbix", "g.r.u.m.b.i.x", "grum-bix", "grumxbix", "snorrfwat", "Blexhead!!"])) > clean
    assert toxicity.units("a g r u x b") == ["a", "g", "r", "u", "x", "b", "agruxb"]


def test_disguised_insults_are_predicted(labelled, spark):
    _, _, docs, table = labelled
    plain = "kalomi sentu diorpa remi pasen tuka ordi loka mire sentuka"
    forms = ["g.r.u.m.b.i.x", "grum-bix", "grumbbix", "snorfwwat", "snor.fwat", "b l e x h e a d", "Blexhead!!", "ble_xhead"]
    new = [(5000 + k, f"{plain} {f} {plain} {f} tumi") for k, f in enumerate(forms)] + [(6000, plain), (6001, plain + " t.u.k.a or-di")]
    got = toxicity.score_toxicity(docs.unionByName(spark.createDataFrame(new, "doc_id long, text string")), table).filter("doc_id >= 5000").collect()
    assert {r.doc_id: r.predicted for r in got} == {i: int(i < 6000) for i, _ in new}


def test_scores_equal_a_plain_twin(labelled):
    rows, labels, docs, table = labelled
    known = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    machine = toxicity.fit([rows[k][1] for k in known], [labels[k][1] == 1 for k in known], sum(labels[k][1] for k in known) / len(known))

    def judged(word):
        return max((float(machine.kernels([p])[0] @ machine.weights) + machine.bias for p in toxicity.pieces(word)), default=machine.bias)

    for r in toxicity.score_toxicity(docs, table).filter("doc_id % 10 = 3").collect():
        second, worst = sorted(judged(w) for w in toxicity.units(rows[r.doc_id][1]))[-2:]
        z = machine.link[0] * worst + machine.link[1] * second + machine.link[2]
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_machine_is_the_least_of_its_cost():
    rng = np.random.default_rng(5)
    groups = [(rng.normal(1, 1, (60, 4)).astype(np.float32), 1.0, 2.0), (rng.normal(-1, 1, (90, 4)).astype(np.float32), -1.0, 0.3)]

    def cost(w):
        hinge = sum(c * (np.maximum(0, 1 - y * (x.astype(float) @ w[:-1] + w[-1])) ** 2).sum() for x, y, c in groups)
        return (w[:-1] ** 2).sum() / 2 + 1e-3 * w[-1] ** 2 / 2 + hinge

    w = toxicity._squared_hinge(groups, block=7)
    assert all(cost(w) < cost(w + 0.01 * step) for step in rng.normal(size=(200, 5)))


def test_sample_is_bounded_in_bytes(labelled, monkeypatch):
    rows, _, docs, table = labelled
    full = toxicity.training_sample(docs, table, 4, 2, "doc_id", "text", "toxic")
    weight = sum(map(len, full[0]))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", weight // 4)
    thin = toxicity.training_sample(docs, table, 4, 2, "doc_id", "text", "toxic")
    assert weight / 8 < sum(map(len, thin[0])) < weight / 2.5 and {True, False} == set(thin[1]) and thin[2] == full[2]
    monkeypatch.setattr(toxicity, "ROW_BYTES", 100)
    assert max(map(len, toxicity.training_sample(docs, table, 4, 2, "doc_id", "text", "toxic")[0])) <= 100


def test_kernel_equals_its_definition():
    def kernel(a, b):
        weight = lambda w: {}
        tables = []
        for w in (a, b):
            weight = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        u = w[i] + w[j] + w[k]
                        weight[u] = weight.get(u, 0) + toxicity.DECAY ** (k - i + 1)
            tables.append(weight)
        return sum(v * tables[1].get(u, 0) for u, v in tables[0].items())

    names = ["^moron$", "^clown$", "^aaaa$", "^banana$"]
    machine = toxicity._landmarks(names)
    got = machine.kernels([*names, "^mor.on$", "^xyz$"])
    for i, a in enumerate([*names, "^mor.on$", "^xyz$"]):
        for j, b in enumerate(names):
            assert got[i, j] == pytest.approx(kernel(a, b) ** 2 / kernel(a, a) / kernel(b, b), abs=1e-4)


def test_labels_are_not_needed_for_an_answer(docs, empty, spark, records):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none)
    assert got.count() == len(records) and got.filter("score > 0 or predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_odd_rows_get_scores(docs, records, labelled):
    both = docs.select("doc_id", "text").unionByName(labelled[2].selectExpr("doc_id + 1000 as doc_id", "text"))
    labels = labelled[3].selectExpr("doc_id + 1000 as doc_id", "toxic")
    got = toxicity.score_toxicity(both, labels)
    assert got.count() == len(records) + 700 and got.filter("score is null or isnan(score)").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
