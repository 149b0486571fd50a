from __future__ import annotations

import fnmatch
import random

from lexmere.llm.url_filter import RULES, Automaton, filter_urls


def brute(url, rules=RULES):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0] or [len(path)])]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "a.www.EXAMPLE.com", "xexample.com", "x.net", "net", "\u0130.net", "com:80", "", "a.org", "u@b.net"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?q=1", "?x=/fr/", "#/es/", "/a.com/", "/x.net/es/", "/en/" + "z" * 5000, "/\n/"]
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "https://", "x", "://", "HTTP://") for _ in range(80)] + [None, "", "http:/x", "a://b://net/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, "http://a.net/fr/")], "page_id long, url string").withColumnRenamed("x", "host")
    got = [tuple(r) for r in filter_urls(pages).collect()]
    want = [(i, *brute(u)) for i, u in enumerate(urls)] + [(0, *brute(urls[0])), (None, *brute("http://a.net/fr/"))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_globs_and_many_words():
    rules = [("*.shop?.com", "/a*z/", "block"), *((f"h{k}.example.org", f"/p{k}/*/q", "block") for k in range(60))]
    automaton = Automaton(rules)
    assert automaton.words > 10
    urls = [".x.shop1.com/a..z/b", ".x.shop12.com/az/", ".shop1.com/az/", ".h7.example.org/p7/anything/q", ".h7.example.org/p8/1/q", ""]
    got = automaton.matches([u.encode() for u in urls])
    assert [int(r.sum()) for r in got] == [1, 0, 0, 1, 0, 0] and got[3].argmax() == 8
    assert fnmatch.fnmatch(urls[0], "*.x.shop?.com/a*z/*")


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
