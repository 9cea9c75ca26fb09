import re
import time

import pytest

from rankloom.llm import htmltext
from rankloom.llm.labelled import PAGES

TEXT = "The council met on Tuesday evening to discuss the new bridge over the river, and members spoke for two hours."


def test_labelled_pages_give_their_region():
    for page in PAGES:
        inner = page.split("<!--[-->")[1].split("<!--]-->")[0]
        assert htmltext.main_text(page) == htmltext.main_text(f"<article>{inner}</article>")


def test_weights_have_their_signs():
    w = htmltext.default_weights()
    assert w["word:main"] > 0 and w["word:other"] > 0 and w["word:outside"] < 0 and w["word:link"] < 0
    assert all(x < 0 for k, x in w.items() if not k.startswith("word:"))


def best_run(found, weights):
    value = [0.0 if x.noise or x.kind == "space" else weights.get(x.kind, htmltext.UNSEEN_TAG) * (x.words or 1) for x in found]
    return max((sum(value[i:j]) for i in range(len(value)) for j in range(i + 1, len(value) + 1)), default=0.0)


def test_the_scan_finds_the_best_run():
    weights = htmltext.default_weights()
    for page in PAGES:
        found = htmltext.items(page)
        a, b = htmltext.region(found, weights)
        got = sum(0.0 if x.noise or x.kind == "space" else weights.get(x.kind, htmltext.UNSEEN_TAG) * (x.words or 1) for x in found[a:b])
        assert abs(got - best_run(found, weights)) < 1e-9


@pytest.mark.parametrize(
    "noise",
    [
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav>",
        "<header><p>The Daily Paper, since 1900</p></header>",
        "<aside><p>Read also this long line about something else</p></aside>",
        '<div class="sidebar"><p>Latest posts are here for you</p></div>',
        '<div id="cookie-notice">We use cookies. <button>Fine</button></div>',
        '<div class="ad-banner">Buy two, pay for one, only today</div>',
        '<form><label>Name</label><input name="n"><textarea>type here</textarea></form>',
        "<script>var t = '<p>not text</p>';</script><style>p{}</style><noscript>Turn it on</noscript>",
        '<section class="comments"><h2>Comments</h2><article class="comment"><p>First! What a fine article this is.</p></article></section>',
        "<!-- a comment <p>hidden</p> -->",
        "<footer><p>All rights reserved</p></footer>",
        '<div hidden><p>not to be seen</p></div>',
    ],
)
def test_what_is_left_out(noise):
    for page in (f"<html><head><title>T</title></head><body>{noise}<article><h1>Bridge</h1><p>{TEXT}</p><p>{TEXT}</p></article>{noise}</body></html>", f"<body><article><h1>Bridge</h1><p>{TEXT}</p>{noise}<p>{TEXT}</p></article></body>"):
        assert htmltext.main_text(page) == f"Bridge\n{TEXT}\n{TEXT}"


def test_an_articles_own_header_keeps_its_headings():
    assert htmltext.main_text(f"<article><header><nav><h2>Menu</h2></nav><h1>Bridge <em>old</em></h1><p>By A. Writer</p></header><p>{TEXT}</p></article>") == f"Bridge old\n{TEXT}"


def test_blocks_space_and_references():
    page = f"<article><p>a&nbsp;&amp;\n\t <b>b</b>c &#x41;&lt;i&gt;</p><p> </p><ul><li>x<li>y</ul><p>{TEXT}<br>{TEXT}</article>"
    assert htmltext.main_text(page) == f"a & bc A<i>\nx\ny\n{TEXT} {TEXT}"


LONG = f"<p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p>"
WANT = "\n".join([TEXT] * 3)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # names that only hold a noise word, and wrappers with one, around the whole page
        (f'<div class="layout has-sidebar"><article>{LONG}</article></div>', WANT),
        (f'<div id="page" class="with-header"><main>{LONG}</main></div>', WANT),
        (f'<div class="content-and-comments">{LONG}</div>', WANT),
        (f'<div class="page has-sidebar"><nav>Home</nav><article>{LONG}</article></div>', WANT),
        (f'<div class="layout-no-banner"><article>{LONG}</article></div>', WANT),
        (f'<div class="sidebar-left"><div><article>{LONG}</article></div></div>', WANT),
        (f'<form id="aspnetForm" action="/"><input name="x"><nav>Home</nav><article>{LONG}</article><label>Mail</label></form>', WANT),
        (f'<body><form method="post"><div>{LONG}</div><input type="submit"></form></body>', WANT),
        # within an article
        (f'<article><p>Buy <span class="share-price">12</span> now</p>{LONG}</article>', f"Buy 12 now\n{WANT}"),
        (f'<article>{LONG}<div class="promo-code-explainer"><p>Main text.</p></div></article>', f"{WANT}\nMain text."),
        (f'<article><h2 id="discussion">Discussion</h2>{LONG}<section id="reviews"><p>Good.</p></section><h2 class="section-header">End</h2></article>', f"Discussion\n{WANT}\nGood.\nEnd"),
        (f'<article>{LONG}<div class="share-buttons"><a href="/f">Share</a></div><div class="related-articles"><article><p>{TEXT}</p></article></div></article>', WANT),
        # what begins or ends the article
        (f"<article><div><p>One.</p></div><div>{LONG}</div></article>", f"One.\n{WANT}"),
        (f"<article><div><div><div><p>One.</p></div></div></div>{LONG}</article>", f"One.\n{WANT}"),
        (f"<body><div>Tuesday</div><article><h1>T</h1><div><img><img><img><img></div>{LONG}</article></body>", f"T\n{WANT}"),
        (f"<body><nav>x</nav><h1>T</h1><div><img><img><img><img></div><div>{LONG}</div></body>", f"T\n{WANT}"),
        (f"<article><table><tr><td>A</td></tr></table>{LONG}</article>", f"A\n{WANT}"),
        (f"<article>{LONG}<ul><li>a</li><li>b</li></ul></article>", f"{WANT}\na\nb"),
        (f"<article>{LONG}<table><tr><td>1</td><td>2</td></tr></table></article>", f"{WANT}\n1\n2"),
        (f"<div><a href='/'>Start</a></div><div>{LONG}<ul><li>a</li><li>b</li></ul></div><div>Imprint</div>", f"{WANT}\na\nb"),
        # layout by tables, unclosed cells
        (f"<table><tr><td><a href='/'>Start</a><br><a href='/x'>Shop</a><td>{LONG}</table>", WANT),
        # quotes that matter, and quotes that don't
        (f'<article title="a > b">{LONG}</article>', WANT),
        (f"<article title=it's><p data-x='<p>no</p>'>{TEXT}</p>{LONG}</article>", f"{TEXT}\n{WANT}"),
        (f"<article><p>1 < 2 & 3 > 2</p>{LONG}</article>", f"1 < 2 & 3 > 2\n{WANT}"),
    ],
)
def test_hand_written_pages(page, want):
    assert htmltext.main_text(page) == want


STRIP = "<div><a href='/'>Start</a> <a href='/n'>News</a> | <a href='/s'>Sport</a></div>"
UNNAMED = [
    # nested divisions with names that tell nothing, a column of links beside the text
    (f'<body><div class="zq1">{STRIP}<div>Signed in as guest</div></div><div class="zq2"><div class="zq3"><h1>Bridge</h1>{LONG}</div><div class="zq4"><h4>More</h4><ul><li><a href="/a">The mill by the lake</a></li><li><a href="/b">The market on Sunday</a></li></ul></div></div><div class="zq5">Printed in town</div></body>', f"Bridge\n{WANT}"),
    # text in plain divisions, short facts before and after
    (f"<body>{STRIP}<section><div>Four minutes</div></section><section><div>{TEXT}</div><div>{TEXT}</div><div>{TEXT}</div></section><section><div>Seen by 2,040 readers</div></section></body>", WANT),
    # short items within the text stay
    (f"<body>{STRIP}<div><h1>Bread</h1><p>{TEXT}</p><ul><li>flour</li><li>water</li></ul><p>{TEXT}</p></div><div>Print this</div></body>", f"Bread\n{TEXT}\nflour\nwater\n{TEXT}"),
    # everything in the body itself
    (f"<body>{STRIP}<div>Late edition</div><h1>Bridge</h1>{LONG}<div>Page two</div></body>", f"Bridge\n{WANT}"),
    # words among links are none of the text
    (f"<body><div>{LONG}</div><div>See also <a href='/1'>the mill by the lake</a> and <a href='/2'>the market on Sunday in the old town</a></div></body>", WANT),
]


@pytest.mark.parametrize(("page", "want"), UNNAMED)
def test_pages_without_article_element_or_known_names(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize(("page", "want"), UNNAMED)
def test_the_scan_alone_decides(page, want, monkeypatch):
    """No element and no name counts as noise."""
    monkeypatch.setattr(htmltext, "_NEVER", frozenset("script style title head".split()))
    monkeypatch.setattr(htmltext, "_UNLESS_MAIN", frozenset())
    monkeypatch.setattr(htmltext, "_NOISE_WORDS", frozenset())
    assert htmltext.main_text(page) == want


def test_given_pages_with_plain_divisions_alone(spark):
    """The table's pages without their telling tags: articles and all else are divisions."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").collect()]
    same = [0, 0]
    for page in pages:
        plain = re.sub(r"<(/?)article[^>]*>", r"<\1div>", page)
        bare = re.sub(r"<(/?)(?:nav|footer)[^>]*>", r"<\1div>", plain).replace('class="ad"', "")
        want = htmltext.main_text(page)
        same[0] += htmltext.main_text(plain) == want
        same[1] += htmltext.main_text(bare) == want
    assert same[0] == len(pages) and same[1] >= 0.9 * len(pages)


@pytest.mark.parametrize("part", ["<a ", "<b>x ", '<a b="', "<head>x ", "<p>", "<div>", "<i><div><b>", "</i>", "<li>", "<td>", "<a ='<a >'", "<!--", "<script>", '<b class="', "&", "<"])
def test_hostile_pages_take_linear_time(part):
    took = []
    for n in (10_000, 80_000):
        start = time.process_time()
        htmltext.main_text(part * n)
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.02)


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<p></p>", "<script>x", "<!--", "<", "<p", "</p></div>"])
def test_nothing_to_find(page):
    assert htmltext.main_text(page) in ("", "<", "<p")


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", f"<article><p>{TEXT}", 3), (3, "u", f"<article><p>{TEXT}", 3), (4, "u", "<p>" + "<b>x " * 50_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in htmltext.extracted(pages).collect()}
    assert got[1].text == got[2].text == "" and got[3].text == TEXT and got[3].n_chars == len(TEXT) and got[4].n_chars >= 99_000
    assert htmltext.extracted(pages).count() == 5 and htmltext.extracted(pages.limit(0)).count() == 0
