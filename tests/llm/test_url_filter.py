import duckdb

from strandline.llm import url_filter as u

URLS = [
    "http://example.org/es/x", "https://A.B.Example.ORG/en/12?q=1", "http://example.org/en/2", "http://example.org", "http://notexample.org/es/", "ftp://x.com/fr/a#b", "http://com/de/", "http://example.com/de", "http://example.net/fr/",
    "no scheme", "", None, "http://?x", "://org/", "http://org/a\nb", "http://user@example.org:80/es/", "http://xorg/", "http://a.org//es/", "http://example.org/es/?http://x.com/de/",
]


def brute(url, rules=u.RULES):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:n].translate(str.maketrans(u.UPPER, u.LOWER)), rest[n:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h.count("."), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_trie_join_and_sql_equal_brute_force(spark):
    rows = [(i, x) for i, x in enumerate(URLS)] + [(0, URLS[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as k")
    want = sorted(((i, *brute(x)) for i, x in rows), key=str)
    assert sorted((tuple(r) for r in u.filter_urls(df, u.RULES).collect()), key=str) == want
    assert sorted((tuple(r) for r in u._joined(df, u.RULES, "page_id", "url", "allow").collect()), key=str) == want
    con = duckdb.connect()
    pages = df.select("page_id", "url").toPandas()  # noqa: F841
    assert sorted(con.sql(u.OP9_SQL).fetchall(), key=str) == want


def test_longest_wins_between_hosts_and_paths(spark):
    rules = [("allow", "org", "/aaaaaaaaaaaa"), ("block", "example.org", "/"), ("allow", "", "/free/"), ("block", "x.y", ""), ("allow", "x.y", "")]
    urls = ["http://example.org/aaaaaaaaaaaab", "http://example.org/b", "http://q.z/free/1", "http://x.y", "http://a.x.y/k"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(0, "allow"), (1, "block"), (2, "allow"), (3, "block"), (4, "block")]
    assert [(r.page_id, r.verdict) for r in u.filter_urls(df, rules).orderBy("page_id").collect()] == want
    assert [(r.page_id, r.verdict) for r in u._joined(df, rules, "page_id", "url", "allow").orderBy("page_id").collect()] == want


def test_empty(spark):
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string"), u.RULES).collect() == []
