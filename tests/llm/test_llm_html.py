"""Main text of pages of several makes."""

import os
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tablelore.llm.html_text import extract_text, main_text

SF = "/root/testdata/sf0.01"
BODY = "Some long enough running text of an article that goes on for a while, and on. "
PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script>"
                f"</head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad -->"
                f"<div class='ad'>Buy now</div><article><h1>Title &amp; more</h1><p><b>{BODY}<br>"
                f"<p>Short.</p><p>a\n  b&nbsp;&eacute;</p></article><footer>&copy; x</footer>",
                ["Title & more", BODY.strip(), "Short.", "a b é"]),
    "main": (f"<body><header>Site</header><div class='cookie-notice'><p>We use cookies</p></div>"
             f"<main><p>{BODY}</p><aside>Related</aside><form><label>Mail</label></form>"
             f"<p>{BODY}End.</p><section id='comments'><article><p>{BODY}</p></article></section>"
             f"</main><footer>f</footer></body>", [BODY.strip(), BODY + "End."]),
    "plain divisions": (f"<body><div id='menu'><a href=x>a</a><a href=y>b</a></div>"
                        f"<div class='content'><h2>Head</h2><p>{BODY * 3}</p><p>Hm.</p>"
                        f"<p>{BODY * 2}</p></div><div class='sidebar'><p>side</p></div></body>",
                        ["Head", (BODY * 3).strip(), "Hm.", (BODY * 2).strip()]),
    "open tags": (f"<body><article><p>{BODY}<p>{BODY}two<ul><li>one<li>two</ul>",
                  [BODY.strip(), BODY + "two", "one", "two"]),
    "no tags": ("just text\n  here &lt;b&gt;", ["just text here <b>"]),
    "boilerplate only": ("<body><nav>Menu</nav><footer>f</footer></body>", []),
    "hidden": (f"<article><p>{BODY}</p><p hidden>no</p><div style='display: none'>no</div>"
               f"<p class='notice'>no</p><p>{BODY}</p></article>", [BODY.strip()] * 2),
    "broken": (f"<article><p>{BODY}</p><![if x]><p>{BODY}</p></article></div></p><", [BODY.strip()] * 2),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_pages(name):
    html, blocks = PAGES[name]
    assert main_text(html) == "\n\n".join(blocks)


REGIONS = {
    "headline beside the body": (f"<body><div><h1>Head</h1><div class=body><p>{BODY * 3}</p><p>{BODY}"
                                 f"</p></div></div></body>", ["Head", (BODY * 3).strip(), BODY.strip()]),
    "list with most of the text": (f"<body><div><p>{BODY}before</p><ul><li>{BODY * 9}</li></ul><p>{BODY}"
                                   f"after</p></div></body>",
                                   [BODY + "before", (BODY * 9).strip(), BODY + "after"]),
    "two divisions": (f"<body><div><p>{BODY * 3}</p></div><div><p>{BODY}</p></div></body>",
                      [(BODY * 3).strip(), BODY.strip()]),
    "sibling articles": (f"<body><nav>Menu</nav><article><p>{BODY * 2}</p></article><article><p>{BODY}"
                         f"</p></article></body>", [(BODY * 2).strip(), BODY.strip()]),
    "list between paragraphs": (f"<body><div>Sale today</div><div><p>{BODY}a</p><ul><li>{BODY * 9}</li></ul>"
                                f"<p>{BODY}b</p></div><div>All rights</div></body>",
                                [BODY + "a", (BODY * 9).strip(), BODY + "b"]),
    "bare divisions": (f"<body><div>{BODY * 2}</div><div>{BODY}</div><div>{BODY * 2}</div></body>",
                       [(BODY * 2).strip(), BODY.strip(), (BODY * 2).strip()]),
    "a menu of links": (f"<body><div><a href=x>a</a><p><a href=y>b</a></div><div><h2>Head</h2><p>{BODY * 3}"
                        f"</p></div></body>", ["Head", (BODY * 3).strip()]),
}


@pytest.mark.parametrize("name", list(REGIONS))
def test_every_region_over_the_threshold_stays(name):
    html, blocks = REGIONS[name]
    assert main_text(html) == "\n\n".join(blocks)


@pytest.mark.parametrize("name", ["page has-sidebar", "overflow-hidden", "with-toc", "no-header",
                                  "sidebar", "widget"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_marks_on_wrappers(name, tag):
    html = (f"<body><div class='{name}'><{tag}><p>{BODY}</p><p>{BODY}</p></{tag}><div class='ad'>{BODY}"
            f"</div></div><div class='comments'><article><p>{BODY * 9}</p></article></div></body>")
    assert main_text(html) == "\n\n".join([BODY.strip()] * 2)


def test_a_long_advert_beside_a_short_article():
    html = f"<body><div class='ad'><p>{BODY * 3}</p></div><article><p>Short text.</p></article></body>"
    assert main_text(html) == "Short text."


def test_marks_inside_the_text():
    html = (f"<body><div id='site-header'>{BODY}</div><main><p>{BODY * 3}</p><div class='related'><article>"
            f"<p>{BODY}</p></article></div><div class='no-ad'><p>{BODY}</p></div></main></body>")
    assert main_text(html) == "\n\n".join([(BODY * 3).strip(), BODY.strip()])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_ratios_find_the_text_without_names():
    """With every telling element made a division and all names gone, the text is the same."""
    telling = r"<(/?)(?:article|main|nav|header|footer|aside|section|form)\b[^>]*>"
    names = r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
    blocks = lost = foreign = found = 0
    for page in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist():
        want = Counter(main_text(page).split("\n\n"))
        plain = re.sub(names, "", re.sub(telling, r"<\1div>", page or ""))
        got = Counter(main_text(plain).split("\n\n"))
        blocks, found = blocks + want.total(), found + got.total()
        lost, foreign = lost + (want - got).total(), foreign + (got - want).total()
    assert blocks > 1000 and lost <= 0.01 * blocks and foreign <= 0.05 * found


N = 600_000
DEEP = {
    "nested divisions": "<div>a line\n" * (N // 12),
    "open tags": "<b " * (N // 3),
    "one tag that is never closed until the end": "<b " * (N // 3) + ">",
    "open comments": "<!--" * (N // 4) + ">",
    "comments that look closed": "<!-- >" * (N // 6),
    "ends of nothing": "<div>x" * (N // 12) + "</nav>" * (N // 12),
    "marked spans": "<span class=ad>" * (N // 30) + "</b>" * (N // 8),
    "marked paragraphs in spans": "<span class=ad><p class=ad>x" * (N // 27),
    "articles in marked divisions": "<div class=ad>t" * (N // 30) + "<article>x" * (N // 20),
    "silent elements": "<svg>" * (N // 10) + "</x>" * (N // 8),
    "ends in a script": "<script>" + "</x" * (N // 3) + ">",
    "quotes": '<a b="' * (N // 6) + ">",
}


@pytest.mark.parametrize("name", list(DEEP))
def test_long_pages_take_linear_time(name):
    page, times = DEEP[name], []
    for part in (page[:len(page) // 4], page):
        start = time.perf_counter()
        main_text(part)
        times.append(time.perf_counter() - start)
    # Four times the page in about four times as long; a squared one would take sixteen.
    assert times[1] < 10 * times[0] + 1.0


def test_deep_pages_lose_nothing():
    html = "<article>" + "".join(f"<div>line {i}" for i in range(20_000))
    assert main_text(html) == "\n\n".join(f"line {i}" for i in range(20_000))
    nested = "<div class='ad'>" * 5_000 + f"<article><p>{BODY}</p></article>" + "</div>" * 5_000
    assert main_text(f"<body>{nested}<div class='ad'>x</div>") == BODY.strip()


@pytest.mark.parametrize("html, text", [
    ("<p>a &#" + "1" * 5000 + "; b</p>", "a \ufffd b"), ("<p>&#0000000000000000065;</p>", "A"),
    ("<p>a</p> 3 < 4 &amp; 5", "a\n\n3 < 4 & 5"),
    ("<p>a <span class=ad>b <p class=ad>c</span> d", "a\n\nd"),
    ("<p>a<p class=ad>b <span class=ad>c</p> d", "a\n\nd"),
    ("<p>a</p><script>b</x> c", "a"),
])
def test_odd_markup(html, text):
    assert main_text(html) == text


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>{BODY}{i}</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None, 5), (1, None, "", 5), (None, "u", "<p></p>", 5), (2, "u", long, 5),
            (2, "u", long, 5), (3, "u", "<p>é𝄞</p>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = extract_text(df).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in got[:3]] == ["", "", ""] and got[5].n_chars == 2
    assert got[3].text == got[4].text == "\n\n".join(f"{BODY}{i}" for i in range(3000))
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(df.limit(0)).count() == 0
