import random

import pytest

from tabwright.llm import url_filter as U


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("rules", [U.RULES, [*U.RULES, ("m.example.com", "/e", "block"), ("org", "", "block"), ("", "/", "block")], []])
def test_against_brute_force(spark, rules):
    rng = random.Random(1)
    hosts = ["example.com", "www.Example.COM", "a.b.www.example.com", "m.example.com", "x.net", "net", "com", "notexample.com", "a..com", "com.", "é.net", "x.org:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/english", "/es/1", "/fr/", "//", "/EN/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#x://y.com/', '?', '/\n'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c.com/en/", "http://example.com/en/" + "x" * 50_000, *["https://hot.example.com/en/1"] * 200]
    rows = [(i if i % 50 else None, u, "h", "a", 3) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, digest int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(map(repr, map(tuple, U.judge(pages, table).collect())))
    assert got == sorted(repr((i, *brute(u, rules))) for i, u, *_ in rows)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, spark.createDataFrame(U.RULES, "host string, path string, verdict string")).count() == 0
