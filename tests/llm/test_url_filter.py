import random

import pytest

from draftmill.llm import url_filter
from draftmill.llm.queries import URL_RULES


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fitting = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fitting.append((len(rule), len(h), rule, verdict))
    best = max(fitting, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "no scheme", "http://WWW.Example.COM/en/x?y", "http://a.com", "x://y://z.com/", "http://com/", "http://xexample.com/en/", "://example.net/es/#a", "https://example.com/en", "http://é.Ü.com/é/", "http://example.com:80/en/", "http://a@example.net/fr/1", "http://" + "a." * 3000 + "net/es/" + "b" * 5000, "http://example.com/en/\nx", "http://www.example.com/en/1/"]


def test_equals_brute_force(spark, rows):
    pages = spark.createDataFrame([(k % 13, u, "x", "y") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES))
    assert rows(got) == sorted(((k % 13, *judge(u, URL_RULES)) for k, u in enumerate([*URLS, *URLS])), key=repr)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, URL_RULES)).count() == 0


def test_long_lists_and_odd_rules(spark, rows):
    rng = random.Random(2)
    rules = [(f"{rng.choice('abc')}{rng.choice(['', 'x'])}.{rng.choice(['com', 'net'])}/{rng.choice(['', 'en/', 'en/us/', 'fr'])}", rng.choice(["allow", "block"])) for _ in range(40)]
    rules = sorted({r: v for r, v in sorted(rules)}.items())
    urls = [f"http://{rng.choice(['', 'w.', 'w.w.'])}{rng.choice('abcd')}{rng.choice(['', 'x'])}.{rng.choice(['com', 'net'])}/{rng.choice(['', 'en/', 'en/us/1', 'france'])}" for _ in range(80)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = url_filter.rule_table(spark, [*rules, (None, "block")])
    assert rows(url_filter.judge_urls(pages, table)) == sorted(((k, *judge(u, rules)) for k, u in enumerate(urls)), key=repr)
    assert url_filter.judge_urls(pages, table.limit(0), default="block").filter("verdict = 'block' and rule is null").count() == 80


@pytest.mark.parametrize("n", [1, 1000])
def test_filter_holds_its_keys_and_few_others(n):
    bloom = url_filter.BlockedBloom(n)
    keys = [f"k{k}".encode() for k in range(n)]
    bloom.add(keys)
    assert bloom.may_hold(keys).all()
    assert bloom.may_hold([f"other{k}".encode() for k in range(5000)]).mean() < 0.02
    assert len(bloom.may_hold([])) == 0


def test_tasks_make_the_same_filter(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PIECE", 7)
    rules = [(f"h{k}.com/", "allow") for k in range(2000)]
    made = url_filter.filter_of(url_filter.rule_table(spark, rules).repartition(3), len(rules))
    own = url_filter.BlockedBloom(len(rules))
    own.add([r.encode() for r, _ in rules])
    assert made.blocks == own.blocks > 7 and (made.bits == own.bits).all()


def test_a_full_filter_only_lets_more_through(spark, rows, monkeypatch):
    monkeypatch.setattr(url_filter.BlockedBloom.__init__, "__defaults__", (1,))
    rules = [(f"h{k}.com/", "block") for k in range(0, 3000, 2)]
    pages = spark.createDataFrame([(k, f"http://h{k}.com/x") for k in range(300)], "page_id long, url string")
    assert rows(url_filter.judge_urls(pages, url_filter.rule_table(spark, rules))) == sorted(((k, *judge(f"http://h{k}.com/x", rules)) for k in range(300)), key=repr)
