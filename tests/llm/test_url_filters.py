from civicframe.llm.components import connected_components
from civicframe.llm.url_filters import RULES, filter_urls


def run(spark, rows, rules=RULES):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")
    return {r.page_id: r for r in filter_urls(df, rules).collect()}


def test_rules(spark):
    urls = ["http://a.net/x", "https://WWW.Example.NET/en/1", "http://example.net/de/1", "http://m.example.com/de/", "http://x.org/fr/a", "http://x.org/de", None, "no-scheme.net/", "http://fakenet/", "http://net", "http://a.net?x=/en/"]
    got = run(spark, [(u, None) for u in urls])
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert (got[1].host, got[1].path) == ("www.example.net", "/en/1") and (got[6].host, got[6].path) == ("", "")


def test_aliases_take_decisions(spark):
    link = '<link href="http://bad.net/p" rel="canonical">'
    refresh = '<meta http-equiv="refresh" content="0; url=/b">'
    pages = [("http://bad.net/p", None), ("http://one.it/a", link), ("http://two.it/a", '<meta http-equiv=refresh content="0;url=http://one.it/a?utm_source=f">'), ("http://two.it/a.html", None), ("http://free.it/", refresh), ("http://free.it/b", None)]
    got = run(spark, pages)
    assert [got[i].verdict for i in range(6)] == ["block", "block", "block", "block", "allow", "allow"]
    allowed = run(spark, [*pages, ("http://three.org/fr/", '<link rel=canonical href="http://two.it/a">')])
    assert [allowed[i].verdict for i in range(7)] == ["block", "allow", "allow", "allow", "allow", "allow", "allow"]


def test_links_are_decoded_and_resolved(spark):
    pages = [
        ("http://bad.net/p?x=1&y=2", None),
        ("http://a.it/1", '<link rel="canonical" href="http://bad.net/p?x=1&amp;y=2">'),
        ("http://b.it/dir/page", '<link href="?v=3" rel="nofollow canonical">'), ("http://b.it/dir/page?v=3", '<meta http-equiv=Refresh content="5; URL=&#39;http://bad.net/p?y=2&#38;x=1&#39;">'),
        ("http://c.it/x/y", '<base href="http://bad.net/"><link rel=canonical href="p?y=2&amp;x=1#top">'),
        ("http://d.it/", '<link rel=canonical href="http://d.it/"><link rel=canonical href="http://bad.net/p?x=1&y=2">'),
        ("http://e.it/", '<!-- <link rel=canonical href="http://bad.net/p?x=1&y=2"> --><script>"<link rel=canonical href=http://bad.net/p?x=1&y=2>"</script>'),
        ("http://f.it/a/b", '<link rel=canonical href="#here"><link rel=canonical href="../c"><link rel=canonical href="http://[bad/">'), ("http://f.it/c", '<link rel=canonical href="//a.it/1">'),
        ("http://g.it/", ""), (None, '<link rel=canonical href="http://bad.net/p?x=1&y=2">'),
    ]
    got = run(spark, pages + pages[:2])
    assert [got[i].verdict for i in range(13)] == ["block"] * 6 + ["allow", "block", "block", "allow", "allow", "block", "block"]


def test_targets_without_a_page_are_judged(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    pages = [
        ("http://a.com/x", link("http://foo.net/y")), ("http://d.com/1", link("http://c.net/")), ("http://e.com/", link("http://c.net/")), ("http://f.com/", link("http://x.org/fr/") + link("http://c.net/z")),
        ("http://g.com/", link("http://neutral.it/")), ("http://h.com/", link("http://g.com/")), ("http://i.com/", link("http://other.it/") + link("http://example.com/de/")), ("http://j.com/", link("http://other.it")),
    ]
    got = run(spark, pages)
    assert [got[i].verdict for i in range(8)] == ["block", "block", "block", "allow", "allow", "allow", "block", "block"]
    assert all(got[i].rule is None for i in range(8))
    twice = run(spark, [("http://a.com/x", None), ("http://a.com/x", link("http://foo.net/y"))])
    assert [twice[i].verdict for i in range(2)] == ["block", "block"]


def test_ten_thousand_linked_pages_against_union_find(spark):
    """Decisions over chains, stars and redirects out of the table, as a plain union-find gives them."""
    import random

    rng = random.Random(9)
    hosts = [f"h{i}.it" for i in range(3000)] + [f"b{i}.net" for i in range(40)] + [f"o{i}.org" for i in range(20)]
    address = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['fr/', 'en/', ''])}{rng.randrange(4)}"
    pages = []
    for i in range(10_000):
        to = "http://hub.it/0" if i % 97 == 0 else address() if rng.random() < 0.3 else None
        pages.append((address(), f'<meta http-equiv=refresh content="0;url={to}">' if to and i % 2 else f'<link rel=canonical href="{to}">' if to else None))
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def own(url):
        host, _, path = url.partition("://")[2].partition("/")
        if host.endswith(".org") and path.startswith("fr/"):
            return "allow"
        return "block" if host.endswith(".net") else None

    links = [(u, h.split("url=")[1].split('"')[0] if "url=" in h else h.split('href="')[1].split('"')[0]) for u, h in pages if h]
    for u, v in links:
        root[find(u)] = find(v)
    said = {}
    for url in {u for u, _ in pages} | {v for _, v in links}:
        said.setdefault(find(url), set()).add(own(url))
    got = run(spark, pages)
    assert len(got) == len(pages)
    for i, (u, _) in enumerate(pages):
        of = said[find(u)]
        assert got[i].verdict == (own(u) or ("allow" if "allow" in of else "block" if "block" in of else "allow"))
    assert sum(own(u) is None and got[i].verdict == "block" for i, (u, _) in enumerate(pages)) > 100


def test_empty_tables(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string, rule int, form string")).count() == 0


def test_the_sql_agrees(spark):
    import duckdb

    from civicframe.llm import url_filters as U

    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    df = U.op10_url_filters(spark, folder)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, duckdb.sql(U.ORACLE["op10_url_filters"]).select(*df.columns).fetchall()))


def test_many_rules_join(spark):
    rules = [*RULES, *[("block", f"h{i}.it", "/") for i in range(300)]]
    got = run(spark, [("http://x.h7.it/a", None), ("http://h.it/", None), ("http://example.net/en/", None)], rules)
    assert [(got[i].rule, got[i].verdict) for i in range(3)] == [("h7.it/", "block"), (None, "allow"), ("example.net/en/", "allow")]


def test_empty_and_chain(spark):
    assert run(spark, [("http://a.it", None)])[0].verdict == "allow"
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and len(got) == 63
    assert connected_components(chain.limit(0)).count() == 0
