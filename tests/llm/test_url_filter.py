import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sylva.llm import url_filter as m

ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/EN/a?x=http://b/c#d", "https://a.net/es/", "a://b://c/d", "http://net/fr/x", "http://xnet/fr/x", "http://example.com", "http://example.com/en", "http://example.com/en/x/1.html#t", "http://e\nx.org/p\nq", "http://ÀB.org/É?q", "http://a.org/" + "p/" * 4000]


def naive(url):
    g = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not g:
        return "", "", None, None
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in g[1]), g[2]
    best = max(((len(r), r, v) for r, v in m.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])), default=(0, None, None))
    return host, path, best[1], best[2]


def pages(rng, n):
    hosts = [f"{s}{b}.{t}" for s in ("", "www.", "m.") for b in ("farm", "news", "example") for t in ("com", "net", "org")]
    return [f"http://{rng.choice(hosts)}/{rng.choice(('en', 'es', 'fr', 'de'))}/{rng.choice(('a', 'buy', 'b'))}-{i}.html" for i in range(n)]


def test_rules(spark):
    urls = ODD + pages(random.Random(1), 300)
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id long, url string, host string, tokens string")
    got = m.judge(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = naive(urls[r.page_id] if r.page_id is not None else None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_rules_mined_as_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for u in pages(rng, 400):
        host, path, _, verdict = naive(u)
        if verdict:
            rows.append((host, path, verdict))
    df = spark.createDataFrame(rows, "host string, path string, verdict string").withColumn("tokens", m.tokens())
    data = [(frozenset(r.tokens), r.verdict) for r in df.collect()]
    n, both, alone = len(data), Counter(), Counter()
    for t, v in data:
        for k in range(1, len(t) + 1):
            for s in combinations(sorted(t), k):
                alone[s] += 1
                both[s, v] += 1
    strong = {(s, v): c / alone[s] for (s, v), c in both.items() if c >= 0.05 * n and c / alone[s] >= 0.7}
    want = {(s, v): c for (s, v), c in strong.items() if not any(c < strong.get((tuple(x for x in s if x != y), v), -1) + m.GAIN for y in s)}
    rules, items = m.mine(df, 0.05, 0.7)
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in rules.collect()}
    of = {r.token: r.item for r in items.collect()}
    # a token that another stands for stands in the same URLs
    assert all({i for i, (t, _) in enumerate(data) if a in t} == {i for i, (t, _) in enumerate(data) if b in t} for a, b in of.items())
    want = {(tuple(sorted({of.get(x, x) for x in s})), v): c for (s, v), c in want.items()}
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_urls_of_many_tokens(spark):
    """Forty distinct words in URLs of one verdict, and in URLs of both."""
    long = "/".join(f"w{i}x" for i in range(40))
    short = [f"http://a{i}.com/en/{i % 3}q" for i in range(20)] + [f"http://b.net/es/{'z' * (i + 1)}" for i in range(6)]
    only = [f"http://long.com/{long}"] * 10
    both = [f"http://long{i}.com/{long}/good" for i in range(8)] + [f"http://long{i}.net/es/{long}/bad" for i in range(5)]
    for urls in (short + only, short + both, only + both):
        urls = [*urls, "http://unknown.org/w3x/bad", "http://unknown.org/w7x/w9x"]
        got = {r.page_id: r.verdict for r in m.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
        assert len(got) == len(urls)
        assert got[len(urls) - 2] == ("block" if urls[-3] in both else "allow")


def test_matching_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(8)]
    rules = [(i, sorted(rng.sample(words, rng.randrange(1, 4))), rng.choice(("allow", "block")), rng.random(), rng.random()) for i in range(30)]
    urls = [(i, sorted(rng.sample(words, rng.randrange(0, 7)))) for i in range(200)]
    got = {r.url_key: r.verdict for r in m.match(spark.createDataFrame(urls, "url_key long, tokens array<string>"), spark.createDataFrame(rules, "rule_id long, tokens array<string>, verdict string, confidence double, support double")).collect()}
    for i, t in urls:
        best = max(((c, s, len(n), n, v) for _, n, v, c, s in rules if set(n) <= set(t)), default=None)
        assert got.get(i) == (best[4] if best else None)


def test_empty(spark):
    assert m.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    one = m.judge(spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")).collect()
    assert [(r.rule, r.verdict) for r in one] == [(None, "allow")]
    assert m.match(spark.createDataFrame([], "url_key long, tokens array<string>"), m.mine(spark.range(0).select(F.array(F.lit("x")).alias("tokens"), F.lit("allow").alias("verdict")))[0]).count() == 0


def test_rules_are_mined_from_all_pages(spark):
    """One URL of many pages against several of one page each."""
    urls = ["http://a.net/es/special"] * 90 + [f"http://b{i}.com/special" for i in range(10)] + ["http://z.org/special"]
    got = {r.page_id: r.verdict for r in m.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == "block" and got[95] == "allow" and got[100] == "block"
