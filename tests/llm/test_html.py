"""Main-text extraction: parsing, alignment, wrappers, whole tables."""
import html
import re

from tidewarp.llm import html_extract as H

SITE = """<html><head><title>T</title><style>p{{}}</style></head><body><div class="cookie-notice">We use cookies</div>
<header><a href="/">Home</a> Site</header><div id="wrap"><div class="menu-x"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
<div id="post-{n}" class="body-text"><h2>Title {n} &amp; more</h2><p>First {a} with a <a href=x>link</a> and&nbsp;text.<p>Second   {b},
also <i>lo</i>ng.<ul><li>item {n}<li>item b</ul><div class="socialShare">tweet</div><p>Sign up today, it costs nothing</p></div>
<div id="comments"><div>Nice {n}!</div></div></div><aside>Side</aside><form><input> Send</form><script>var x = "</p>";</script><footer>Foot {n}</footer>"""


def site(n):
    return SITE.format(n="abcdefgh"[n], a="para " * (n + 20), b="words " * (30 - n))


def want(n, constant):
    blocks = [f"Title {'abcdefgh'[n]} & more", f"First {'para ' * (n + 20)}with a link and text.", f"Second {'words ' * (30 - n)}, also long.".replace("words ,", "words ,"),
              f"item {'abcdefgh'[n]}", "item b"] + ["Sign up today, it costs nothing"] * constant
    return "\n\n".join(" ".join(b.split()) for b in blocks)


def test_page_alone():
    assert H.page_text(site(3)) == want(3, True)
    for nothing in (None, "", "   ", "<html></html>", "<nav>menu</nav>", "<!-- c -->", "<script>x"):
        assert H.page_text(nothing) == ""
    assert H.page_text("plain text &lt;only&gt;") == "plain text <only>"
    assert H.page_text("<article><p>a <b>b<br>c<p>d &eacute;&#233;&#x41;</article>") == "a b c\n\nd ééA"
    assert H.page_text("<article>x<p class='ad'>buy</p><section class=comments><p>c</section><header>By me<h1>Head</h1></header>y</article><p>out") == "x\n\nHead\n\ny"
    assert H.page_text("<main><div>one</div><article><p>two</article></main>") == "two"
    long = "<article>" + "<p>para graph</p>" * 20000 + "</article>"
    assert H.page_text(long) == "\n\n".join(["para graph"] * 20000)
    deep = "<div>" * 200 + "text" + "</div>" * 200
    assert H.page_text(deep) == "text"


def test_wrapper_drops_constant_nodes_of_a_host():
    tree = None
    for n in range(5):
        s = H.outline(H.parse(site(n)))
        tree = s if tree is None else H.merge(tree, s)
    rule = H.wrapper(tree)
    assert not rule[2]
    assert H.page_text(site(6), rule) == want(6, False)


def induced(pages):
    tree = None
    for p in pages:
        s = H.outline(H.parse(p))
        tree = s if tree is None else H.merge(tree, s)
    return H.wrapper(tree)


def test_copies_prove_nothing_constant():
    a = "<h1>Alpha</h1><p>first words</p><ul><li>i<li>j</ul><p>a single p</p><table><tr><td>q</table><pre>code</pre><h3>Head</h3><blockquote>said</blockquote>"
    text = H.page_text(a)
    assert [w in text for w in ("a single p", "code", "Head", "said")] == [True] * 4
    for pages in ([a, a, "<h1>Beta</h1><p>other words"], [a] * 60 + [f"<h1>Gamma {n}</h1><p>other {n}" for n in range(40)]):
        assert H.page_text(a, induced(pages)) == text
        assert H.page_text(a, induced(pages[::-1])) == text


def test_constant_nodes_of_a_section_on_part_of_a_host():
    section = [f"<h1>Title {n}</h1><p>words of {n}</p><pre>Boiler</pre>" for n in range(3)]
    rule = induced(section + [f"<h1>Title {n}</h1><p>words of {n}</p>" for n in range(3, 20)])
    assert H.page_text(section[0], rule) == "Title 0\n\nwords of 0"


def test_tree_matching_aligns_siblings():
    a, b = (H.outline(H.parse(p)) for p in ("<div><h1>x</h1><p>1</p><pre>c</pre></div>", "<div><p>2</p><p>3</p><table><tr><td>q</table><pre>c</pre></div>"))
    assert H._match(a, b) == 4  # root, div, p, pre
    m = H.merge(a, b).children[0]
    assert [c.label for c in m.children] == ["h1", "p", "table", "pre"] and [c.pages for c in m.children] == [1, 2, 1, 2]
    assert m.children[1].text is None and m.children[3].text


def test_trim_bounds_a_wrapper(monkeypatch):
    monkeypatch.setattr(H, "NODES", 10)
    tree = None
    for n in range(30):
        s = H.outline(H.parse(f"<div class='c{'abcdefghij'[n % 10]}x{'klmno'[n // 6 % 5]}'><p>t</div><div class=same><p>u {n}</div>"))
        tree = H._trim(s if tree is None else H.merge(tree, s))
    assert H._count(tree) <= 10


def test_trim_keeps_what_holds_the_article(spark):
    pairs = "".join(f"<h2>Part {'{0}'} {n}</h2><p>Text {'{0}'} {n}</p>" for n in range(1200))
    marked = "<html><body><div class=top><h1>The site</h1></div><article>" + pairs + "</article><div>All rights kept</div></body></html>"
    plain = "<html><body><div class=top><h1>The site</h1></div><div class=text>" + pairs + "</div></body></html>"
    odd = "<html><body><div class=top><h1>The site {0}</h1></div>{1}<article><p>Text {0}</article></body></html>"
    letters = "abcdefghij"
    unlike = "".join(f"<div class={'{0}'}{letters[n // 100 % 10]}{letters[n // 10 % 10]}{letters[n % 10]}x>w</div>" for n in range(1000))
    rows = []
    for n in range(4):
        rows.append((n, "http://marked.example/", marked.format(n), "\n\n".join(f"Part {n} {i}\n\nText {n} {i}" for i in range(1200))))
        rows.append((10 + n, "http://plain.example/", plain.format(n), "\n\n".join(f"Part {n} {i}\n\nText {n} {i}" for i in range(1200))))
        rows.append((20 + n, "http://odd.example/", odd.format(n, unlike.format("klmn"[n])), f"Text {n}"))
    rows.append((30, "http://one.example/", marked.format(9), "\n\n".join(f"Part 9 {i}\n\nText 9 {i}" for i in range(1200))))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert [i for i, _, _, text in rows if got[i] != text] == []


def test_a_host_without_slots_in_its_wrapper_has_no_rule(monkeypatch):
    monkeypatch.setattr(H, "NODES", 10)
    page = "<div class=head><p>{0}</p></div><div class=body{0}><p>" + "long text {0} " * 9 + "</p></div>"
    tree = None
    for c in "abcdefghijklmnop":
        s = H.outline(H.parse(page.format(c)))
        tree = H._trim(s if tree is None else H.merge(tree, s))
    assert H.wrapper(tree) is None
    assert H.page_text(page.format("q"), H.wrapper(tree)) == " ".join(["long text q"] * 9)


def test_edges_on_spark(spark):
    rows = [(i, f"http://h.example/{i}", site(i), "x", 1) for i in range(6)] + [(7, None, site(7), "x", 1), (8, "http://h.example/8", None, "x", 1), (None, "odd", "", "x", 1),
            (0, "http://h.example/0", site(0), "x", 1), (9, "HTTP://u@H.EXAMPLE:80/z", "<p>other layout altogether", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule int").repartition(4)
    got = {(r.page_id, r.url): r.text for r in H.main_text(pages).collect()}
    for i in range(6):
        assert got[i, f"http://h.example/{i}"] == want(i, False)
    assert got[7, None] == want(7, True) and got[8, "http://h.example/8"] == "" and got[None, "odd"] == ""
    assert got[9, "HTTP://u@H.EXAMPLE:80/z"] == "other layout altogether"
    assert H.main_text(pages).count() == len(rows) and H.main_text(pages.limit(0)).count() == 0


def test_table_against_its_layout(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        plain = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
        assert got[r.page_id] == "\n\n".join(b for b in plain if b)


def test_deep_nesting_and_tags_without_end():
    import time

    began = time.time()
    for n in (600, 5000, 100_000):
        assert H.page_text("<div>" * n + "text" + "</div>" * n + "<p>more") == "text\n\nmore"
        assert H.page_text("<b>" * n + "text" + "</b>" * n) == "text"
        assert H.page_text("<div>" * n + "<nav>menu</nav>one<p>two<b>bold</b></p>three</div>four") == "one\n\ntwobold\n\nthree\n\nfour"
        assert H.page_text("<ul><li>" * n + "item") == "item"
        assert H.page_text("<section>" * n + "x" + "</article>" * n) == "x"
    assert H.page_text("<p>a</p>" + "<div <" * 20_000) == "a\n\n" + "<div <" * 20_000
    assert H.page_text("<p>a <!-- open " + "<b" * 20_000) == "a"
    assert H.page_text("<p>a" + "<a href='x" * 20_000 + "b").startswith("a")
    assert time.time() - began < 60


def test_pages_of_many_blocks_align_in_reasonable_time():
    import time

    def page(n):
        return f"<html><body><div class=top>Site</div><div id=c>" + "".join(f"<h3>Head {n} {i}</h3><p>Para {n} {i} of the text</p>" for i in range(20_000)) + "</div></body></html>"

    began = time.time()
    pages = [page(n) for n in range(3)]
    rule = induced(pages)
    text = H.page_text(pages[1], rule)
    assert text.endswith("Head 1 19999\n\nPara 1 19999 of the text") and text.count("\n\n") >= 39_999
    assert time.time() - began < 60


def test_deep_page_does_not_spoil_its_host(spark):
    deep = "<div>" * 20_000 + "deep text"
    rows = [(i, f"http://h.example/{i}", site(i)) for i in range(5)] + [(9, "http://h.example/9", deep), (10, "http://d.example/1", deep), (11, "http://d.example/2", "<b>" * 3000 + "x")]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == "deep text" and got[11] == "x" and "deep text" in got[9]
    assert all(f"Title {'abcdefgh'[i]} & more" in got[i] for i in range(5))
