from __future__ import annotations

import random

import pytest

from cohortspark.llm import url_filter
from cohortspark.llm.queries import URL_RULES


@pytest.mark.parametrize("listed, unlisted, max_words", [(40, 400, 1 << 20), (200, 50, 1 << 20), (300, 900, 8), (0, 30, 8), (30, 0, 8)])
def test_the_cascade_is_exact(spark, listed, unlisted, max_words):
    draw = random.Random(listed)
    keys = [f"host{draw.randrange(10**9)}.example.org" for _ in range(listed + unlisted)]
    corpus = spark.createDataFrame([(k,) for k in keys * 2], "key string")
    listing = spark.createDataFrame([(k,) for k in [*keys[:listed], None]], "key string")
    cascade = url_filter.build(corpus, listing, max_words)
    if max_words == 8 and listed == 300:
        assert len(cascade.levels) > 1
    found = {r.key: r.on_list for r in cascade.with_answer(corpus, "key", "on_list").collect()}
    assert found == {k: k in set(keys[:listed]) for k in keys}


CASES = [
    ("http://WWW.Example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://b.example.com/en/?q=/x", "b.example.com", "/en/", "example.com/en/", "block"),
    ("https://bexample.com/en/", "bexample.com", "/en/", "com/", "allow"),
    ("https://b.example.com/fr/#/en/", "b.example.com", "/fr/", "com/", "allow"),
    ("https://b.example.com", "b.example.com", "", None, "allow"),
    ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("https://x.net/de/1", "x.net", "/de/1", None, "allow"),
    ("https://www.spam-farm.example.org/de/", "www.spam-farm.example.org", "/de/", None, "block"),
    ("https://www.spam-farms.example.org/de/", "www.spam-farms.example.org", "/de/", None, "allow"),
    ("ftp://a://b/c", "a:", "//b/c", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("https://É.net/fr/", "É.net", "/fr/", "net/fr/", "block"),
]


def test_rules_and_verdicts(spark):
    pages = spark.createDataFrame(
        [(n, c[0], "h", "p", "clash") for n, c in enumerate(CASES)] + [(None, CASES[0][0], "h", "p", "clash")],
        "page_id long, url string, host string, path string, verdict string",
    )
    listed = url_filter.hosts_with_labels(pages, ["spam-farm"])
    found = url_filter.judged(pages, URL_RULES, listed)
    rows = {r.page_id: tuple(r)[1:] for r in found.collect()}
    assert rows == {**{n: c[1:] for n, c in enumerate(CASES)}, None: CASES[0][1:]}
    assert "Python" not in found._jdf.queryExecution().toString()
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none, URL_RULES, url_filter.hosts_with_labels(none, ["x"])).count() == 0
