from tallyrake.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy, now, this, good, thing, today.</div>
%s
<footer>&copy; site</footer></body></html>"""
LONG = "This is a sentence of the article, with some commas, and enough words to count as text."


def test_article_element():
    body = f"<article><h1>Head</h1><p><b>Bold.<br><p>{LONG}</p><p>Short &amp; sweet.</p><ul><li>one<li>two</ul></article>"
    assert main_text(PAGE % body) == f"Head\nBold.\n{LONG}\nShort & sweet.\none\ntwo"


def test_plain_divisions():
    body = (f'<div id="wrap"><div class="sidebar"><p>{LONG}</p></div><div class="col"><h2>Head</h2><p>{LONG}</p>\n<p>{LONG}  x\ty&nbsp;z</p>'
            f'<form><p>{LONG}</p></form></div><div class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>')
    assert main_text(PAGE % body) == f"Head\n{LONG}\n{LONG} x y z"


def test_sections_of_unequal_length_are_all_kept():
    body = f"<main><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><p>Tiny.</p></section></main>"
    assert main_text(PAGE % body).split("\n") == [LONG] * 3 + ["Tiny."]


def test_siblings_of_the_best_container():
    body = (f'<div><div class="x"><p>{LONG}</p><p>{LONG}</p></div><div class="y"><p>{LONG}</p></div>'
            f'<div class="z"><a href=1>More links here, and here</a> <a href=2>and here</a></div></div>')
    assert main_text(PAGE % body).split("\n") == [LONG] * 3


def test_cookie_notice_and_link_lists_go():
    body = (f'<div role="dialog"><p>{LONG}</p></div><div id="cookie-notice"><p>{LONG}</p></div><article><p>{LONG}</p>'
            f'<ul><li><a href=1>Related one</a><li><a href=2>Related two</a></ul><aside><p>{LONG}</p></aside></article>')
    assert main_text(PAGE % body) == LONG


def test_headers_of_articles_and_wrappers_named_after_parts_stay():
    body = (f'<header><h1>Site</h1></header><div class="page with-sidebar"><main><article><header><h1>Head</h1></header><p>{LONG}</p>'
            f'<div class="article-header"><p>Sub</p></div></article></main><div class="sidebar"><p>{LONG}</p></div></div>'
            f'<section id="comments"><article class="comment"><p>{LONG}</p></article></section>')
    assert main_text(PAGE % body).split("\n") == ["Head", LONG, "Sub"]


def test_content_boxes_without_semantic_elements():
    body = (f'<div id="header"><p>{LONG}</p></div><div id="content"><div class="post"><h1>Head</h1><div class="entry"><p>{LONG}</p>'
            f'<p>Second, short.</p><div class="share-buttons"><a href=1>Share</a></div><p>{LONG}</p></div></div>'
            f'<div class="cookie-banner">We use cookies, as all do, and more.</div><form><p>{LONG}</p></form></div><div id="footer">{LONG}</div>')
    assert main_text(PAGE % body).split("\n") == ["Head", LONG, "Second, short.", LONG]


def test_linked_paragraphs_of_the_article_stay():
    body = f'<article><p>{LONG}</p><p><a href="/r">The full report</a></p><p>{LONG}</p></article>'
    assert main_text(PAGE % body).split("\n") == [LONG, "The full report", LONG]


def test_names_only_discount_a_box():
    box = f'<div class="elementor-widget elementor-widget-text-editor"><div class="elementor-widget-container"><p>{LONG}</p></div></div>'
    title = '<div class="elementor-widget elementor-widget-heading"><h2>Head</h2></div>'
    foot = "<div>All rights reserved by the site and its owners.</div>"
    assert main_text(f"<div id=content class='site-content has-sidebar'><div>{LONG}</div><div>{LONG}</div></div>{foot}").split("\n")[:2] == [LONG] * 2
    assert main_text(PAGE % f"<article>{title}{box}{box}</article>") == f"Head\n{LONG}\n{LONG}"
    assert main_text(PAGE % f'<div class="elementor">{title}{box}{box}</div>') == f"Head\n{LONG}\n{LONG}"
    paper = f'<section id="intro"><p>{LONG}</p><p>{LONG}</p></section><section class="related-work"><p>{LONG}</p></section><section id=discussion><p>{LONG}</p></section>'
    for around in ("article", "div"):
        assert main_text(PAGE % f"<{around}>{paper}</{around}>").split("\n") == [LONG] * 4
    notes = f'<section class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>'
    assert main_text(PAGE % f"<article>{paper}{notes}</article>").split("\n") == [LONG] * 4
    assert main_text(PAGE % "<article><h1>Tiny head.</h1><p>Tiny.</article>") == "Tiny head.\nTiny."


def test_bare_text_is_kept():
    lines = [f"{LONG} Line {k}." for k in range(3)]
    foot = "Copyright of the site and its owners."
    assert main_text("<html><body>" + "<br>".join(lines) + f"<div>{foot}</div></body></html>") == " ".join(lines) + "\n" + foot
    body = f'<div>Lead <b>in bold</b>.<div class="x"><p>{LONG}</p><p>{LONG}</p></div>Tail text.<a href=1>Home</a></div>'
    assert main_text(PAGE % body).split("\n") == ["Lead in bold.", LONG, LONG, "Tail text.Home"]
    body = f'<div><a href=1>Home</a> | <a href=2>About</a><div class="x"><p>{LONG}</p><p>{LONG}</p></div></div>'
    assert main_text(PAGE % body).split("\n") == [LONG, LONG]


def test_only_menus_are_left_out_of_the_article():
    refs = '<ol><li>Ada: <a href=1>On the engine, its notes and its numbers</a></li><li><a href=2>A second work with a rather long title</a></li></ol>'
    lead = f'<div><a href="/r">{LONG}</a></div>'
    short = "<h2>Sources</h2><ul><li><a href=1>Reuters</a><li><a href=2>AP</a></ul>"
    menu = "<h3>Related</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><a href=1>Home</a> | <a href=2>About</a></div>"
    body = f"<article>{lead}<div><p>{LONG}</p><p>{LONG}</p></div>{refs}{short}{menu}</article>"
    assert main_text(PAGE % body).split("\n") == [
        LONG, LONG, LONG, "Ada: On the engine, its notes and its numbers", "A second work with a rather long title",
        "Sources", "Reuters", "AP", "Related"]


def test_defined_cases(spark):
    assert main_text(None) == main_text("") == main_text("<html></html>") == ""
    assert main_text("just text < 5 & more") == "just text < 5 & more"
    assert main_text("<p>unclosed <b>bold") == "unclosed bold"
    assert main_text("<div " * 3 + "x") is not None
    deep = "<div>" * 5000 + LONG + "</div>" * 5000
    assert main_text(deep) == LONG
    rows = [(1, "u", PAGE % f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "x"), (None, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["id"]: (r["url"], r["text"], r["n_chars"]) for r in extract(df).collect()}
    assert got == {1: ("u", LONG, len(LONG)), 2: (None, "", 0), None: ("u", "", 0)}
    assert extract(df.limit(0)).collect() == []


def test_test_pages_give_their_articles(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)
        if inner:
            parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split(r"</?(?:p|h1|h2)>", inner.group(1))]
            assert main_text(r["html"]) == "\n".join(x for x in parts if x)
