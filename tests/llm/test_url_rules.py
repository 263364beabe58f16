from evenhand.llm.url_rules import RULES, judge_urls


def judged(spark, urls, rules=RULES, **kw):
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, table, **kw).orderBy("page_id").collect()]


def brute(url, rules, default="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = lambda s, stops: s[:min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host):], "?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_against_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://NET/x", "http://net", "http://net?x", "https://a.example.net/en/1?q#f", "https://A.Example.NET/en",
        "http://example.com/de/", "http://xexample.com/de/", "http://a.org/fr/x", "http://org/fr/", "http://org/frx", "a://b://c/en/", "http://..net/", "http://x.net:80/",
        "http://é.net/ü", "http://" + "a." * 3000 + "net/" + "p" * 20000, "http://net/\nx", "http://a.example.net/en/", "http://a.example.net/en/",
    ]
    assert judged(spark, urls) == [brute(u, RULES) for u in urls]


def test_rules_of_any_shape(spark):
    rules = [("a.b.c", "", "block"), ("b.c", "/x", "allow"), ("c", "/xyz", "block"), ("c", "/xyz", "allow"), ("", "/", "block"), ("d", "/longer", "allow"), ("e.d", "/long", "block")]
    urls = ["http://a.b.c/", "http://a.b.c/x", "http://z.a.b.c", "http://b.c/x1", "http://c/xyz1", "http://c/xy", "http://e.d/longer"]
    assert judged(spark, urls, rules) == [brute(u, [r for r in rules if r[0]]) for u in urls]
    assert judged(spark, urls, [], default="block")[0][3] == "block"
    assert judged(spark, [], rules) == []
