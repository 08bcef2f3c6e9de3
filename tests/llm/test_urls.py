from netweir.llm import urls as U
from netweir.llm.queries import RULES

URLS = ["http://a.example.org/es/x", "HTTP://Example.ORG/es/", "http://example.org/en/123?q#f", "http://badexample.org/es/1", "http://org/",
        "http://x.com/fr/a", "https://com/de/", "ftp://y.net/de/", "http://example.org", "http://example.org?x://z.com/de/", "no scheme", "", None,
        "a://b://c.com/fr/", "http:///es/", "http://É.ORG/\n/x", "http://example.org./es/", "http://example.org/es/", "http://example.org:80/es/1"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i % 5 or None, u, "x", "x") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string, host string")
    got = sorted(map(str, U.judge_urls(pages, rules, ["page_id"]).collect()))
    want = spark.createDataFrame([(i % 5 or None, *brute(u)) for i, u in enumerate(URLS + URLS[:3])],
                                 "page_id long, host string, path string, rule string, verdict string")
    assert got == sorted(map(str, want.collect()))
    assert U.judge_urls(pages.limit(0), rules, ["page_id"]).count() == 0
    assert {r.verdict for r in U.judge_urls(pages, rules.limit(0), ["page_id"], default="block").collect()} == {"block"}


def test_equal_lengths_block_first(spark):
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("a.b", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([("http://a.b/",)], "url string")
    assert U.judge_urls(pages, rules, ["url"]).first().verdict == "block"
