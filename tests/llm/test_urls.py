from gradus.llm import urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "bad.net", "/")]


def judge(spark, rows, redirects=None, extra=""):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string" + extra)
    r = None if redirects is None else spark.createDataFrame(redirects, "from_url string, to_url string")
    return {x.page_id: x for x in urls.filter_urls(pages, RULES, r).collect()}


def test_rules(spark):
    u = ["http://a.example.org/es/1", "https://Example.ORG/en/12", "http://x.org/en/1", "http://notexample.org/es/", "ftp://b.com/de/x?y#z", "http://c.com/fr/", "http://c.com", "http://com/de/", "a.com/de/",
         None, "", "://org/", "http://org?/x", "http://d.com/x?http://e.org/", "http://a.example.org/en/2"]
    got = judge(spark, [(i, x, None) for i, x in enumerate(u)])
    want = [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "/en/1", "org/", "allow"), ("notexample.org", "/es/", "org/", "allow"),
            ("b.com", "/de/x", "com/de/", "block"), ("c.com", "/fr/", "com/fr/", "allow"), ("c.com", "", None, "allow"), ("com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("org", "/", "org/", "allow"), ("org", "", None, "allow"), ("d.com", "/x", None, "allow"), ("a.example.org", "/en/2", "org/", "allow")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(u))] == want


def test_decisions_reach_aliases(spark):
    link, move = '<link rel="canonical" href="%s">', "<META http-equiv='refresh' content='0; URL=%s'>"
    rows = [(1, "http://a.net/1", link % "http://b.net/x"), (2, "http://b.net/x", move % "/y"), (3, "https://www.b.net/y.html?utm_source=z#top", link % "//bad.net/q"),
            (4, "http://c.net/1", link % "rel/page"), (5, "http://m.c.net/rel/page/", ""), (6, "http://d.net/", link % "http://bad.net/1" + link % "http://fine.org/1"),
            (7, "http://e.net/1?a=1&ref=2", None), (8, "http://f.net/k", link % "http://x.com/fr/1"), (9, "http://g.net/", link % "http://f.net/k"), (10, "http://bad.net/only", "")]
    got = judge(spark, rows, [("http://e.net/1?a=1", "http://bad.net/moved"), (None, "http://g.net/"), ("http://c.net/rel/page", "http://h.net")])
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "block"}
    assert got[1].rule is None and got[10].rule == "bad.net/"


def test_long_chain_and_hub(spark):
    rows = [(i, f"http://chain.net/{i}", f'<link rel=canonical href="http://chain.net/{i + 1}">') for i in range(60)]
    rows[-1] = (59, "http://chain.net/59", '<link rel=canonical href="http://bad.net/end">')
    rows += [(100 + i, f"http://hub{i}.net/a", '<link rel="canonical" href="http://hub.net/">') for i in range(60)] + [(99, "http://bad.net/hub", '<link rel="canonical" href="http://hub.net/">')]
    got = judge(spark, rows)
    assert {r.verdict for r in got.values()} == {"block"} and len(got) == 121


def test_odd_rows(spark):
    rows = [(1, "http://a.net/", "<a>" * 50_000, "x"), (1, "http://a.net/", "<a>" * 50_000, "x"), (None, "http://bad.net/", "", None), (2, None, None, "y"), (3, "http://" + "a" * 9000 + ".net/de/", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    out = urls.filter_urls(pages, RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.count() == 5
    assert out.where("page_id is null").first().verdict == "block"
    assert urls.filter_urls(pages.where("false"), RULES).count() == 0
    assert urls.filter_urls(pages, []).where("verdict = 'allow'").count() == 5
