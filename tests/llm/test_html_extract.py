from rankweave.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy</div>
<div id="cookie-notice">Cookies</div><article><h1>Head &amp; line</h1><p><b>One<br>two<p>Three &#233;&nbsp;four</p>
<aside>Side</aside><ul><li>a<li>b</ul><form><label>Mail</label></form><div class="share box">Share it</div>
<table><tr><td>x<td>y</table><section class="comments"><p>A reader</p></section></article><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert H.main_text(H.parse(PAGE)) == "Head & line\nOne two\nThree é four\na\nb\nx\ny"


def test_broken_pages():
    assert H.main_text(H.parse("")) == ""
    assert H.main_text(H.parse("<article><p>cut &am")) == "cut &am"
    assert H.main_text(H.parse("<article><p>cut<a hre")) == "cut"
    assert H.main_text(H.parse("plain <b>text</b>\n\n here")) == "plain text here"
    assert H.main_text(H.parse("<p>a</b></div>b<script>x")) == "ab"
    assert H.main_text(H.parse("<div>" * 5000 + "deep")) == "deep"
    assert H.main_text(H.parse("<article><header><h1>T</h1></header><p>x</article><article class=comment><p>no</article>")) == "T\nx"


def test_templates(spark):
    same = "<div class='box'>Same on all</div>"
    rows = [(i, f"https://h{i % 2}.example.org/{i}", f"<html><body>{same if i % 2 == 0 else ''}<div>Own text {i}</div><p>Often</p></body></html>", "x") for i in range(60)]
    rows += [(100 + i, f"http://u@H9.example.org:80/{i}", f"<body>{same}<article><p>Often</p><div>Share {i % 1}</div><p>Text {i}</article>", "x") for i in range(30)]
    rows += [(200, None, None, "x"), (201, "", "", "x"), (202, "no url", "<p>t</p>", "x"), (202, "no url", "<p>t</p>", "x")]
    got = {}
    for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert sum(map(len, got.values())) == len(rows) and len(got[202]) == 2
    assert [got[i][0].text for i in (0, 1)] == ["Own text 0", "Own text 1"]
    assert got[105][0].text == "Often\nText 5" and got[202][0].text == "t" and got[200][0].text == got[201][0].text == ""
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_labels_are_whole_names():
    text = lambda page: H.main_text(H.parse(page))
    for label in ("post has-sidebar", "category-social tag-search", "with-sidebar", "related", "post comments-open"):
        assert text(f"<div class='page'><article class='{label}'><p>Own</p></article></div>") == "Own"
        assert text(f"<main class='{label}'><article class='{label}'><p>Own</p></article></main>") == "Own"
    assert text("<main><div class='search'><article><p>Own</p></article></div><div class='search'>Find</div></main>") == "Own"
    assert text("<div class='comments-open has-comments'><article><p>Own</p></article></div>") == "Own"
    assert text("<div class='page no-sidebar'><p>Own</p><div class='sidebar'>Side</div><div id='share-buttons'>Share</div></div>") == "Own"
    assert text("<article><p>Own</p><div class=comment-list><article><p>A reader</p></article></div></article>") == "Own"


def test_templates_by_count(spark):
    notice = "<div class='x7'><p>Read our other pages</p></div>"
    long = "<p>" + "A text that stands on every page. " * 8 + "</p>"
    page = lambda i, more: f"<body><article><h1>Title</h1><p>Own <em>not</em> {i}</p><table><tr><th>Name<th>Size</tr><tr><td>k<td>{i}</tr></table>{more}</article></body>"
    rows = [(i, "http://big/", page(i, notice + long if i < 12 else "")) for i in range(100)]
    rows += [(200 + i, "http://small/", page(i, notice)) for i in range(3)]
    rows += [(300 + i, "http://plain/", f"<div>Own {'<em>not</em>' if i < 12 else ''} {i}</div>" + ("<div class='x7'>Side</div><p>Yes</p>" if i < 12 else "")) for i in range(100)]
    rows += [(400 + i, "http://copies/", f"<body>{i}<article><div><p>Same text</p></div></article></body>") for i in range(30)]
    rows += [(500, "http://rows/", "<div><p>Same row</p></div>")] * 30
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(100):
        assert got[i] == f"Title\nOwn not {i}\nName\nSize\nk\n{i}"
    assert [got[200 + i] for i in range(3)] == [f"Title\nOwn not {i}\nName\nSize\nk\n{i}" for i in range(3)]
    assert all(got[300 + i] == f"Own not {i}\nYes" for i in range(12))
    assert all(got[400 + i] == "Same text" for i in range(30)) and got[500] == "Same row"
