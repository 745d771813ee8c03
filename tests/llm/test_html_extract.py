import html
import math
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from civicframe.llm import html_extract as H
from civicframe.llm.html_extract import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>menu one</a></li><li><a href=/b>menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head&amp;line</h1><p>by somebody</p></header>
<p>First   paragraph\nwith &lt;tags&gt; &#233; and <a href=x>a link</a>.<p>Second one <b>bold<br>line</b></p><form><input>mail</form>
<ul><li>one<li>two</ul><aside>aside</aside></article><section id="comments"><p>What a long comment this reader wrote about it</p></section>
<div class="sidebar">side</div><footer>&copy; site</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE).split("\n\n") == ["Head&line", "First paragraph with <tags> é and a link.", "Second one bold line", "one", "two"]


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<article><h1>x</h1><p><b>y.<br></article>", "x\n\ny."), ("<p>cut <b", "cut"), ("<script>only", ""), ("a < b & c", "a < b & c")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_density_without_declared_container():
    body = "".join(f"<p>{'a long sentence of running text ' * 8}{i}.</p>" for i in range(5))
    page = f"<body><div><a href=1>one</a><a href=2>two</a></div><div id=x>{body}</div><div><a href=3>three</a></div></body>"
    assert main_text(page).count("\n\n") == 4 and "one" not in main_text(page)


def test_ordinary_words_in_classes_stay():
    inside = '<section id="related-work"><p>other work</p></section><h2 id="share-prices">prices</h2><p class="notice-period">three months</p><div class="post social"><p>posted text</p></div>'
    page = f'<body><article><p>text</p>{inside}<div class="related"><a href=1>more of it</a></div><div class="newsletter">mail<input></div></article></body>'
    assert main_text(page).split("\n\n") == ["text", "other work", "prices", "three months", "posted text"]


def test_threshold_leaves_an_inner_container():
    text = "".join(f"<p>{'a long sentence of running text ' * 8}{i}.</p>" for i in range(5))
    links = "".join(f"<a href={i}>link</a>" for i in range(9))
    assert "link" not in main_text(f"<body><div id=page><div>{links}</div><div>{text}</div></div></body>")
    both = main_text(f"<body><div id=page><div>{links}</div><div>{text}</div><div>{text}</div></div></body>")
    assert both.count("\n\n") == 9 and "link" not in both


def test_several_articles():
    page = "<body><main>" + "".join(f"<article><p>{f'text of number {i} ' * (i + 3)}</p></article>" for i in range(3)) + "</main></body>"
    assert main_text(page).count("\n\n") == 2
    assert main_text(page.replace("main>", "div>")).count("\n\n") == 2
    long = "".join(f"<p>{'many words of a long text ' * 9}{i}.</p>" for i in range(6))
    assert main_text(f"<body><main><article>{long}</article><article><p>a short one</p></article></main></body>").endswith("a short one")


def plain_page(seed):
    """A page without any telling tag, class or id: (html, text of its article)."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    links = lambda n: "".join(f'<li><a href="/{i}">{words(1)}</a></li>' for i in range(n))
    blocks = [words(rng.randint(40, 90)) for _ in range(rng.randint(4, 9))]
    title = words(6)
    text = "".join(f"<p>{b}</p>" for b in blocks)
    inner = (f"<div><h2>{title}</h2>{text}</div>", f"<table><tr><td><h2>{title}</h2>{text}</td></tr></table>", f"<div><h2>{title}</h2><div>{text}</div></div>")[seed % 3]
    side = f"<div><ul>{links(8)}</ul><p>{words(3)}</p></div>"
    page = f"<html><body><div><div><ul>{links(12)}</ul></div><div>{inner}{side}</div><div><p>{words(2)}</p><ul>{links(5)}</ul></div></div></body></html>"
    return page, "\n\n".join([title, *blocks])


def test_pages_without_telling_names(monkeypatch):
    pages = [plain_page(i) for i in range(60)]
    assert sum(main_text(page) == text for page, text in pages) == len(pages)
    monkeypatch.setattr(H, "composite", lambda *_: 0.0)  # it is the densities that tell
    assert sum(main_text(page) == text for page, text in pages) == 0


def test_densities_are_those_of_the_definition():
    for seed in range(20):
        page = PAGE if seed == 19 else plain_page(seed)[0].replace("<li>", '<li class="menu">' if seed % 4 == 0 else "<li>", 3)
        root, pieces = H.parse(page)
        body = H.measure(root, pieces)

        def counts(node):
            """(characters, tags, characters and tags of links) below a node, by walking it afresh."""
            c = 0 if node.drop else sum(len(t) - t.count(" ") for n, t in pieces if n is node and t and not t.isspace())
            t, lt, lc = 0, 0, c * is_linked(node)
            for k in node.kids:
                kc, kt, klc, klt = counts(k)
                w = H.HINTED if k.hint else 1
                c, lc = c + w * kc, lc + w * klc
                t, lt = (t + 1 + kt, lt + (k.tag == "a") + klt) if not k.drop else (t, lt)
            return c, t, lc, lt

        def is_linked(node):
            return node is not None and (node.tag == "a" or is_linked(node.up))

        bc, _, blc, _ = counts(body)
        stack, best, most = [body], None, 0
        while stack:
            node = stack.pop()
            c, t, lc, lt = counts(node)
            if c and not node.drop:
                t, lt = max(t, 1), max(lt, 1)
                want = c / t * math.log(max(1, c / max(1, lc) * t / lt) + 1) / math.log(math.log(c / max(1, c - lc) * lc + blc / bc * c + math.e) + 1)
                assert node.density == pytest.approx(want * (H.HINTED if node.hint else 1))
            stack += node.kids
        core = H.core_of(body)
        chosen, threshold = H.main_nodes(body)
        path, node = [], core
        while node is not None:
            path.append(node)
            node = node.up if node is not body else None
        assert threshold == min(n.density for n in path) and core in chosen


def test_the_given_pages_are_their_articles():
    """They all hold one article, with headings, paragraphs and character references."""
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])
    for page in table.column(0).to_pylist():
        (article,) = re.findall(r"<article>(.*?)</article>", page, re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<br ?/?>", " ", re.sub(r"</?(?!br)[a-z][^>]*>", "", b))).split()) for b in re.split(r"</?(?:p|h1|h2|ul|li)>", article)]
        assert main_text(page) == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text", "<b>" * 50_000 + "</z>" * 50_000 + "<li>x" * 1000, '<div class="ad">' * 50_000 + "x<p>y", "<a " * 50_000, "<p><table>" * 50_000], ids=range(5))
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 3


def test_adverts_and_comments_within_an_article():
    page = f"<body><article><h1>t</h1><p>{'long running text ' * 20}</p><div class=ad>buy this</div><p>short.</p><div id=comments><p>{'a long comment of a reader ' * 9}</p></div></article></body>"
    assert main_text(page).split("\n\n")[2:] == ["short."] and main_text(page).startswith("t\n\nlong")


def test_column(spark):
    df = spark.createDataFrame([(1, PAGE, "t", 5), (2, None, "t", 5), (3, "<p>" + "w " * 100_000, "t", 5), (1, PAGE, "t", 5)], "page_id long, html string, text string, text_ int")
    rows = extract_text(df).collect()
    got = {r.page_id: r for r in rows}
    assert got[1].text == "t" and got[1].text_ == 5 and got[2].text__ == "" and len(got[3].text__) == 199_999
    assert len(rows) == 4 and len({r.text__ for r in rows}) == 3
    assert extract_text(df.limit(0)).count() == 0


def test_empty_comments_hide_nothing():
    two = "<p>One paragraph with quite a few words in it, so that it counts as text.</p><p>Another one that is about as long as the first was.</p>"
    want = main_text(f"<div>{two}</div>")
    assert want.count("paragraph") == 1 and want.count("\n\n") == 1
    for comment in ("<!-->", "<!--->", "<!---->", "<!-- x --!>", "<!-- > -- -->", "<!--->-->"):
        got = main_text(f"<div>{comment}{two}</div>")
        assert got.replace("-->\n\n", "") == want, comment
    assert main_text(f"<div>{two}<!-- open {two}</div>") == want


def test_only_void_elements_close_themselves():
    text = "Words of a paragraph that go on and on until they are enough. " * 3
    page = f"<body><div><p>{text}</p><p>{text}<a href=http://x.com/>a link</a> and more.</p><br/><hr/><p>{text}</p></div></body>"
    assert "a link and more." in main_text(page) and main_text(page).count("Words of") == 9
    assert main_text(page) == main_text(page.replace("href=http://x.com/", 'href="http://x.com/"'))


def test_reader_comments_by_parts_of_names():
    text = "The article has a long paragraph of text that nobody would take for anything else at all. " * 4
    said = "<div class=c><p>Reader one says that this was a very good article and thanks the author for it.</p></div>" * 6
    for name in ("post-comments", "comments", "entry_comments", "article-comments-list", "disqus_box"):
        got = main_text(f"<body><article><p>{text}</p><p>{text}</p><div class='{name}'>{said}</div></article></body>")
        assert "Reader" not in got and got.count("The article") == 8, name
    outside = main_text(f"<body><article><p>{text}</p><p>{text}</p></article><div id='comment-17'>{said}</div></body>")
    assert "Reader" not in outside and outside.count("The article") == 8
    kept = main_text(f"<body><article class='has-comments'><div class='no-comments'><p>{text}</p><p>{text}</p></div></article></body>")
    assert kept.count("The article") == 8


def test_the_query_has_its_columns(spark):
    from civicframe.llm.html_extract import op8_html_extraction

    df = op8_html_extraction(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    rows, pages = df.collect(), spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(rows) == len(pages)
    html = {p.page_id: (p.url, p.html) for p in pages}
    assert all((r.url, r.text, r.n_chars) == (html[r.page_id][0], main_text(html[r.page_id][1]), len(r.text)) for r in rows)
