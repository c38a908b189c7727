import itertools

from chunkloom.llm import urlfilter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("COM", "/de/", "block"),
         ("a.b.c.d", "", "block"), ("tie.net", "/x", "allow"), ("tie.net", "/x", "block"), (None, "/", "block"), ("", "/", "block"), ("nul.net", None, "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[:end]


def judged(url):
    host, path = parts(url)
    fits = [
        (len(h) + len(p or ""), h.lower() + (p or ""), v) for h, p, v in RULES
        if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")
    ]
    best = max(fits, default=None)
    return (host, path, best[1], best[2]) if best else (host, path, None, "allow")


def test_equals_brute_force(spark):
    hosts = ["org", "x.org", "example.org", "WWW.Example.ORG", "notexample.org", "example.org.evil", "com", "a.com", "z.a.b.c.d", "a.b.c.d.", "tie.net", "nul.net", "é.org", "..org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/13?x=/es/", "/en/2#/es/", "/fr/é", "/de/", "?q", "#f", "/x" * 3000]
    urls = [f"{s}://{h}{p}" for s, h, p in itertools.product(("http", "a://b"), hosts, paths)] + [None, "", "no scheme/es/", "://example.org/es/"]
    rows = [(i, u, "v") for i, u in enumerate(urls)] + [(0, urls[0], "v"), (None, urls[1], "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urlfilter.judge(pages, rules).collect()), key=repr)
    assert got == sorted([(i, *judged(u)) for i, u, _ in rows], key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES[:2], "host string, path string, verdict string")
    assert [tuple(r) for r in urlfilter.judge(pages, rules.limit(0), "block").collect()] == [(1, "a.org", "/", None, "block")]
    assert urlfilter.judge(pages.limit(0), rules).collect() == []
