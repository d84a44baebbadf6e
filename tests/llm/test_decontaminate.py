import hashlib

import pytest

from draftmill.llm.decontaminate import contamination, decontaminate, normal_words


@pytest.fixture(scope="module")
def benchmark(spark, records):
    long = [t.split() for _, t in records[:8]]
    items = [(k, " ".join(w[:25])) for k, w in enumerate(long)] + [(20, long[0][0]), (21, "x"), (22, None), (23, "!!"), (24, "never seen words " * 5), (25, " ".join(long[1][2:6])), (None, " ".join(long[2][:12])), (20, long[0][0]), (3, " ".join(long[3][3:20]))]  # 20 and 3 stand for two items each
    return items, spark.createDataFrame(items, "item_id long, text string")


def brute(items, text):
    w, hit, found = normal_words(text), set(), set()
    for i, t in items:
        v = normal_words(t)
        windows = [v[k : k + 10] for k in range(len(v) - 9)] if len(v) >= 10 else [v] if v else []
        at = [(k, len(x)) for x in windows for k in range(len(w) - len(x) + 1) if w[k : k + len(x)] == x]
        if at:
            found.add("" if i is None else str(i))
        hit |= {k + j for k, n in at for j in range(n)}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("automaton_words", [200_000, 30])  # one pass, and several
def test_equals_brute_force(docs, records, rows, benchmark, automaton_words):
    items, table = benchmark
    assert rows(contamination(docs, table, automaton_words=automaton_words)) == sorted(((i, *brute(items, t)) for i, t in records), key=repr)


def test_words():
    assert normal_words("Ab-C1 é_x\x7fÀ") == [b"ab", b"c1", "é".encode(), "xÀ".encode()[:1], "À".encode()]
    assert normal_words(None) == normal_words("") == []


def test_spans_are_cut(spark, rows):
    items = spark.createDataFrame([(1, "c d e f g h i j k l m"), (2, "q r")], "item_id int, text string")
    texts = [(1, "x y z w v, (C d e f g h i j k l m)! u t s p o n more words here", 5), (2, None, 6), (3, "q r and so on", 7), (4, "c d e f g h i j k l m a", 8), (5, "", 9)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, _items int")
    got = rows(decontaminate(docs, items))
    assert got == [(1, "x y z w v, ( )! u t s p o n more words here", 5), (2, None, 6), (3, "q r and so on", 7), (5, "", 9)]


def test_no_rows(docs, empty, benchmark, spark):
    _, table = benchmark
    assert contamination(empty, table).count() == 0
    none = contamination(docs, table.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == docs.count()
