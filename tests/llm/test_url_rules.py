"""URL rules against brute force."""

import random
import re

from tidewell.llm.entry import URL_RULES
from tidewell.llm.url_rules import url_verdicts

COLUMNS = "page_id long, url string, host long, _key string, rule string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(pages, rules, default="allow"):
    known = {}
    for h, p, v in rules:
        if h and v is not None:
            known[lower(h), p or ""] = max(v, known.get((lower(h), p or ""), v))
    out = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = lower(host)
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out.append((i, host, path, best[2], best[3]))
    return sorted(out, key=str)


def run(spark, pages, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, 1, "k", "r") for i, u in pages], COLUMNS).repartition(3)
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted((tuple(r) for r in url_verdicts(pages, rules, default).collect()), key=str)


def test_rules_of_the_query(spark):
    hosts = ["com", "a.com", "Example.COM", "www.example.com", "m.www.example.com", "notexample.com", "net", "x.net", "org", "com.org", "", "a..com", "com.", "example.com:80", "ü.com"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/2", "/fr/", "/EN/", "?a=/en/", "#/en/", "/en/?x://y.net/es/", "/" + "p" * 30_000]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths] + ["com/en/", "://", None, "", "a://b://example.com/en/", "x\ny://com/\nz"]
    pages = [(i // 2, u) for i, u in enumerate(urls)] + [(None, "http://example.com/en/")] * 3 + [(7, "http://net/es/1")] * 20
    assert run(spark, pages, URL_RULES) == brute(pages, URL_RULES)


def test_nested_rules_over_many_ranges(spark):
    rng = random.Random(4)
    labels = ["a", "b", "c"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choices(["x", "y", "xy"], k=rng.randint(0, 4)))
    rules = [(host(), rng.choice([path(), None, "", path()]), rng.choice(["allow", "block"])) for _ in range(300)]
    rules += [("a", "/x", "block"), ("a", "/x", "allow"), (None, "/", "block"), ("b", "/", None), ("", "/", "block"), ("A.B", "/y", "block")]
    pages = [(i, f"http://{host()}{path()}?q") for i in range(2000)]
    assert run(spark, pages, rules, "none") == brute(pages, rules, "none")


def test_no_rules_and_no_pages(spark):
    pages = [(1, "http://a.com/"), (2, None)]
    assert run(spark, pages, []) == brute(pages, [])
    assert run(spark, [], URL_RULES) == []
