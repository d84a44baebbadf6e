import random
from itertools import pairwise

import pytest

from draftmill.llm import substring_dedup as sd


def words(rng, n):
    return ["".join(rng.choice(["ka", "lo", "mi", "re", "tu", "sen"]) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def corpus():
    rng = random.Random(5)
    passage = [words(rng, 30), words(rng, 28)]
    near = [w[:] for w in passage]
    near[0][9] = "edited"
    out = []
    for k in range(24):
        lines = [words(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 4))]
        if k % 3 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = [passage[0], ["a", "b"], passage[1]] if k % 2 else [*near]
        if k % 4 == 0:
            lines.append(passage[1])  # 28 words alone are too few for a passage
        out.append((k, "\n".join(" ".join(w) for w in lines)))
    return [*out, (50, None), (51, ""), (None, out[0][1]), (52, out[1][1]), (52, out[1][1])]


def brute(records, similarity, least):
    occurrences, names = [], []
    for i, t in records:
        if i is not None:
            for k, w in enumerate(sd.paragraphs(t)):
                occurrences.append((i, k, tuple(w)))
                names.append(tuple(w))
    names = list(dict.fromkeys(names))
    sets = {w: {w[j : j + 5] for j in range(max(1, len(w) - 4))} for w in names}
    root = {w: w for w in names}
    find = lambda w: w if root[w] == w else find(root[w])
    for a in names:
        for b in names:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for o in occurrences:
        groups.setdefault(find(o[2]), []).append(o)
    hits = {}
    for members in groups.values():
        if len({m[0] for m in members}) > 1:
            first = min(m[:2] for m in members)
            for i, k, w in members:
                hits.setdefault(i, []).append((k, len(w), len(members), first[0], (i, k) != first))
    out = []
    for i, rows in hits.items():
        places = sorted({r[0] for r in rows})
        runs, run = [], places[:1]
        for a, b in pairwise(places):
            if b != a + 1:
                runs.append(run)
                run = []
            run.append(b)
        for run in [*runs, run]:
            own = [r for r in rows if r[0] in run]
            if sum(r[1] for r in own) >= least:
                out += [(i, *r) for r in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [1500, 1])  # whole groups, and blocks of them
def test_equals_brute_force(spark, rows, monkeypatch, part):
    monkeypatch.setattr(sd, "PART", part)
    records = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in records], "doc_id long, text string, place int, paragraph long, words string").repartition(3)
    found = sd.repeated_passages(docs, window_words=10**6)
    expected = brute(records, 0.8, 50)
    assert len({r[0] for r in expected}) >= 6
    assert rows(found.select("doc_id", "place", "n_words", "class_size", "first_id", "removed")) == expected
    if part > 1:
        cut = {r.doc_id: r.text for r in sd.remove_passages(docs, window_words=10**6).collect()}
        gone = {(r[0], r[1]) for r in expected if r[5]}
        for i, t in records:
            if i is not None:
                assert len(sd.paragraphs(cut[i])) == len(sd.paragraphs(t)) - len({k for j, k in gone if j == i})


def test_passages_inside_longer_lines(spark):
    rng = random.Random(8)
    passage = words(rng, 80)
    texts = [(k, " ".join([*words(rng, 60 + k), *(passage if k < 4 else []), *words(rng, 70 - k)])) for k in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sd.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and {r.removed for r in got if r.doc_id == 0} == {False}
    for r in got:
        assert 60 + r.doc_id <= r.first_word and r.first_word + r.n_words <= 140 + r.doc_id and r.class_size == 4 and r.first_id == 0
    cut = {r.doc_id: r.text.split() for r in sd.remove_passages(docs).collect()}
    for k, t in texts:
        own = t.split()
        left = [w for j, w in enumerate(own) if not any(r.doc_id == k and r.removed and r.first_word <= j < r.first_word + r.n_words for r in got)]
        assert cut[k] == left and (len(left) < len(own)) == (k in (1, 2, 3))


def test_bands_reach_their_recall():
    bands, rows = sd.tune_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= sd.VALUES
    with pytest.raises(ValueError, match="recall"):
        sd.tune_bands(0.1, values=4)


def test_all_odd_rows(docs, empty):
    assert sd.repeated_passages(docs, least_words=5).filter("doc_id between 200 and 214").count() >= 15
    assert sd.repeated_passages(docs, least_words=5, inside=True).count() >= sd.repeated_passages(docs, least_words=5).count()
    assert sd.repeated_passages(empty).count() == 0
    assert sd.remove_passages(docs).count() == docs.count()


def covered(records, n):
    """id -> words that windows of n words cover which another id has too, by looking at all windows."""
    streams = [(i, t.lower().split()) for i, t in records]
    owners = {}
    for i, w in streams:
        for k in range(len(w) - n + 1):
            owners.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {i: {k + j for k in range(len(w) - n + 1) if len(owners[tuple(w[k : k + n])]) > 1 for j in range(n)} for i, w in streams}


@pytest.mark.parametrize("wrapped", [False, True])  # inside long lines; over lines of other lengths in each text, short ones too
def test_no_window_is_missed(spark, wrapped):
    rng = random.Random(21)
    records = []
    for k in range(0, 120, 2):
        passage = words(rng, 48 + k % 14)  # 48 to 60 words, those of under 51 are none
        for j in range(2):
            w = [*words(rng, rng.randint(20, 70)), *passage, *words(rng, rng.randint(20, 70))]
            at = 0
            while wrapped and at < len(w) - 1:
                at += rng.choice([1, 2, 3, 4, 9, 14, 20])
                w[at:at] = ["\n"] if at < len(w) else []
                at += 1
            records.append((k + j, " ".join(w)))
    expected = {i: c for i, c in covered(records, 51).items() if c}
    assert len(expected) > 80
    docs = spark.createDataFrame(records, "doc_id long, text string").repartition(3)
    got = {}
    for r in sd.repeated_passages(docs).filter("place is null").collect():
        assert r.n_words >= 51 and r.class_size == 2 and r.removed == (r.doc_id % 2 == 1) and r.first_id == r.doc_id // 2 * 2
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    assert got == expected
    cut = {r.doc_id: r.text.split() for r in sd.remove_passages(docs).collect()}
    for i, t in records:
        assert cut[i] == [w for j, w in enumerate(t.split()) if i % 2 == 0 or j not in expected.get(i, ())]


@pytest.mark.parametrize("chunk", [10**6, 60])  # one chunk a task; many, whose verdicts meet
def test_what_one_document_repeats_is_told_apart(spark, monkeypatch, chunk):
    monkeypatch.setattr(sd, "WINDOW_CHUNK", chunk)
    rng = random.Random(4)
    own, shared = words(rng, 60), words(rng, 55)
    records = [(1, [*own, *words(rng, 9), *own]), (2, [*words(rng, 30), *shared]), (3, [*shared, *words(rng, 30)]), (4, words(rng, 200)), (4, words(rng, 80))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in records], "doc_id long, text string").repartition(2)
    shown = lambda **kw: sorted((r.doc_id, r.first_word, r.n_words, r.class_size, r.first_id, r.removed) for r in sd.repeated_passages(docs, **kw).collect())
    across = [(2, 30, 55, 2, 2, False), (3, 0, 55, 2, 2, True)]
    assert shown() == across
    twice = docs.unionByName(docs.filter("doc_id = 2"))  # a row repeated with its id keeps its passage in both
    assert {(r.doc_id, r.removed) for r in sd.repeated_passages(twice).collect()} == {(2, False), (3, True)}
    assert sorted(len(r.text.split()) for r in sd.remove_passages(twice).filter("doc_id in (2, 3)").collect()) == [30, 85, 85]
    assert shown(inside=True) == sorted([*across, (1, 0, 60, 2, 1, False), (1, 69, 60, 2, 1, True)])


def test_a_passage_of_very_many_documents(spark):
    rng = random.Random(12)
    passage = words(rng, 52)
    others = lambda k, side: [f"{side}{k}x{j}" for j in range(rng.randint(0, 9))]
    docs = spark.createDataFrame([(k, " ".join([*others(k, "a"), *passage, *others(k, "b")])) for k in range(700)], "doc_id long, text string").repartition(6)
    got = sd.repeated_passages(docs).filter("place is null").collect()
    assert {r.doc_id for r in got} == set(range(700)) and {(r.n_words, r.class_size, r.first_id) for r in got} == {(52, 700, 0)}
    assert [r.doc_id for r in got if not r.removed] == [0]
