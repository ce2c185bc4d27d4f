import numpy as np

from lumenfold.llm import urls


def brute(url, rules, default="allow"):
    host, path = urls.parts(url)
    best = None
    for action, rule in rules:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return host, path, best and best[1], best[0] if best else default


URLS = [
    "http://A.Example.NET/en/1?x#y", "https://example.net/en", "https://example.net", "http://net/", "net/", None, "", "://",
    "ftp://x.example.com/de/83?page=2", "http://badexample.com/de/1", "http://example.com/DE/1", "http://a.org/fr/", "http://org/fr/x#://b",
    "http://examİple.net/", "https://a.net?/en/", "http://a.net://b/", "http://" + "s." * 5000 + "net/" + "p" * 100000,
]


def test_as_brute_force(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, host int")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(df).collect()}
    assert got == {i: brute(u, urls.RULES) for i, u in enumerate(URLS * 2)}


def test_collisions_are_confirmed(spark, tmp_path, monkeypatch):
    rules = [("block", "a.com/"), ("allow", "b.com/"), ("block", "c.com/x")]
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    (tmp_path / "i").write_bytes(urls.pack(rules))
    index = urls.Index(str(tmp_path / "i"))
    assert len(np.unique(index.keys)) < len(rules)
    for host, path, want in (("a.com", "/z", "a.com/"), ("x.b.com", "/", "b.com/"), ("c.com", "/xy", "c.com/x"), ("d.com", "/", None)):
        j = index.judge([(host, path)])[0]
        assert (index.rule(j) if j >= 0 else None) == want


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge_urls(df, []).collect()] == ["allow"]
    assert urls.judge_urls(df.limit(0)).collect() == []


def test_several_files_give_the_same(spark, monkeypatch):
    rules = [*urls.RULES, ("allow", "net/"), ("block", "org/fr/x"), ("block", "example.net/en/1")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    monkeypatch.setattr(urls, "INDEX_BYTES", 40)
    assert len(list(urls.segments(rules))) > 3 and list(urls.segments([])) == [[]]
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}
