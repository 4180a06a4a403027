from shelfwise.llm import url_filters as U
from shelfwise.llm.queries import URL_RULES

URLS = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/12?x=/es/", "http://b.org/es/",
        "http://notexample.org/es/1", "http://x.com/de/1#f", "http://x.com/fr/1", "x.com/de/1",
        None, "", "://", "ftp://", "http://example.org", "http://com/fr/", "HTTP://Ex.Com/FR/",
        "http://y.net/de/" + "p" * 5000, "http://" + "a." * 3000 + "com/de/é", "http://example.org/en/1",
        "http://u@h.com:80/de/", "a://b.com/fr/c://d.com/de/"]
URLS += URLS[:2]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def judge(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string")
    r = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    return {x.page_id: (x.host, x.path, x.rule, x.verdict)
            for x in U.judge_urls(pages, r).collect()}


def test_contract_rules(spark):
    got = judge(spark, URLS, URL_RULES)
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}


def test_precedence_and_conflicts(spark):
    rules = [("com", "/de/abc", "allow"), ("x.com", "/de/", "block"), ("x.com", "", "allow"),
             ("y.net", "/", "allow"), ("y.net", "/", "block"), ("", "/", "block")]
    urls = URLS + ["http://x.com/de/abc", "http://q.x.com/", "http://y.net", "http://y.net/q"]
    assert judge(spark, urls, rules) == {i: brute(u, rules[:3] + [("y.net", "/", "block")])
                                         for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    r = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    assert U.judge_urls(pages, r).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert U.judge_urls(one, none).first().verdict == "allow"
