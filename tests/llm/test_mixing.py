import hashlib
import math

import pytest
from pyspark.sql import functions as F

from draftmill.llm import mixing


def draw(i, rate, seed=0):
    """Copies by the same rule in plain Python."""
    pieces = max(1, math.ceil(rate / mixing.PIECE))
    n = 0
    for k in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{k}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        term = total = math.exp(-rate / pieces)
        j = 0
        while total <= u and j < 200:
            j += 1
            term *= rate / pieces / j
            total += term
        n += j
    return n


def test_equals_plain_draws(docs, records):
    rates = {r[0]: r[1] for r in mixing.source_rates(docs).collect()}
    got = mixing.mix_sources(docs)
    assert got.columns == [*docs.drop("_copies").columns, "_copies", "_copy", "_order"]
    counts = {}
    for r in got.collect():
        assert 1 <= r._copy <= r._copies
        key = (r.doc_id, r.text, r.source)
        counts[key] = counts.get(key, 0) + 1
    expected = {}
    for r in docs.select("doc_id", "text", "source").collect():
        if n := draw(r.doc_id, rates[r.source]):
            expected[tuple(r)] = expected.get(tuple(r), 0) + n
    assert counts == expected


def test_shares_reach_their_targets(spark):
    df = spark.createDataFrame([(k, "a" if k % 10 else "b", "t" * 9) for k in range(20_000)], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("gone", 5.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix_sources(df, weights, total=2.0).groupBy("source").count().collect()}
    assert got["a"] + got["b"] == pytest.approx(40_000, rel=0.03) and got["b"] / (got["a"] + got["b"]) == pytest.approx(0.75, abs=0.02)
    only = mixing.mix_sources(df, weights.filter("source = 'b'"))
    assert {r.source for r in only.select("source").distinct().collect()} == {"b"}


def test_counts_follow_the_distribution(spark):
    for mean in (0.4, 3.0, 40.0):
        pieces = max(1, math.ceil(mean / mixing.PIECE))
        u = lambda k: mixing.hashed(F.lit("z"), F.lit(str(k)), F.col("id").cast("string")) / float(1 << 52)
        n = sum((mixing.poisson_count(u(k), F.lit(mean / pieces)) for k in range(pieces)), F.lit(0))
        row = spark.range(20_000).select(n.alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert row[0] == pytest.approx(mean, rel=0.05) and row[1] == pytest.approx(mean, rel=0.06)


def test_plan_is_native_and_empty_tables_stay_empty(docs, empty):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert mixing.mix_sources(empty).count() == 0


def test_odd_weights(docs, spark):
    rates = lambda rows: {r[0]: r[1] for r in mixing.source_rates(docs, spark.createDataFrame(rows, "source string, weight double")).collect()}
    once, twice = rates([("s0", 3.0), ("s1", 1.0)]), rates([("s0", 2.0), ("s0", 1.0), ("s1", 1.0), ("s1", None)])
    assert once == twice and once["s0"] > 0 and once[None] == 0
    assert set(rates([("stranger", 1.0)]).values()) == set(rates([("s0", 0.0)]).values()) == {0.0}
    assert mixing.mix_sources(docs, spark.createDataFrame([("stranger", 1.0)], "source string, weight double")).count() == 0
    for bad in (-1.0, float("nan")):
        with pytest.raises(Exception, match="negative"):
            rates([("s0", bad)])
