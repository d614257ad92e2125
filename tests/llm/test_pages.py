"""Main text of pages of several layouts."""

from html import escape

import pytest

from parlance.llm.pages import extracted, main_text, smoothed

BODY = ["It was a long way from the harbour to the old mill, and nobody had walked it since the storm.",
        "To.", "The second paragraph speaks of <b>bread</b>, of sal<i>ted</i> fish &amp; of 3 &lt; 4 things, at some length.",
        "A third one,\n   with a line\tbreak inside and a <a href='/x'>link to another page</a>, closes the story for today."]
TEXT = ("It was a long way from the harbour to the old mill, and nobody had walked it since the storm. To. The second paragraph speaks of bread, "
        "of salted fish & of 3 < 4 things, at some length. A third one, with a line break inside and a link to another page, closes the story for today.")
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us and our very long history in this town</a></li></ul></nav>"
NOISE = ("<div class='ad'>Buy the best shoes in town, now with two soles and a free lace for every single customer.</div>"
         "<form><label>Search</label><input name=q><button>Go and find it</button></form>")
FOOT = "<footer>&copy; Example. All rights reserved by the owner of this page and by nobody else in this world.</footer>"

PAGES = {
    "article": f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NAV}{NOISE}<article><h1>Title</h1>{PARAGRAPHS}</article>{FOOT}</body></html>",
    "open tags": f"<html><body>{NAV}<article><h1>Title</h1><p>" + "<p>".join(BODY) + f"</article>{FOOT}",
    "main and aside": f"<body><header><h2>Site name</h2></header>{NAV}<main><h1>Title</h1>{PARAGRAPHS}<aside>Other stories that you might like to read after this one, if there is time.</aside></main>{FOOT}",
    "divs only": f"<body><div id='header'>The daily paper of the town, since 1890</div><div class='menu'><a href=/>Home</a></div><div class='col'><h1>Title</h1>{PARAGRAPHS}</div><div class='sidebar'>{NOISE}<p>Weather today: rain, and more of it in the evening hours of the day.</p></div><div id=footer>Imprint</div></body>",
    "comments": f"<body><article><h1>Title</h1>{PARAGRAPHS}<section id='comments'><p>First! I have read all of it and I do not agree with any of it, at all, ever, said a reader.</p></section></article><div class=cookie-banner>We use cookies to make this page better for you, please accept all of them.</div></body>",
    "hidden": f"<body><article><header><h1>Title</h1></header>{PARAGRAPHS}<p style='display: none'>Nobody sees this sentence here.</p><p hidden>Nor this sentence here.</p></article></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    assert main_text(PAGES[name]) == f"Title {TEXT}"


def test_single_cases():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x()</script>") == ""
    assert main_text("just  text &amp; no\nmarkup") == "just text & no markup"
    assert main_text("<p>a&nbsp;b<p>c") == "a b c"
    assert len(main_text("<article>" + "<p>many words in here</p>" * 50_000)) == len("many words in here ") * 50_000 - 1
    assert main_text("<" * 1000) is not None and main_text("<p>cut <b") is not None


def test_smoothing_keeps_a_level():
    import numpy as np

    assert np.allclose(smoothed(np.full(9, 3.0)), 3.0)
    assert smoothed(np.array([0.0, 0, 9, 0, 0]))[2] < 9


def test_given_pages(llm, nothing):
    pages = llm.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = extracted(pages.withColumn("text", pages.url)).collect()
    assert len(rows) == pages.count()
    for row in rows:
        assert row.n_chars == len(row.text) and row.text
        inside = row.html[row.html.index("<h1>") : row.html.index("</article>")]
        for word in row.text.split()[:200]:
            assert escape(word, quote=False) in inside
        assert row.html.split("<div class=\"ad\">")[1].split("</div>")[0] not in row.text
    odd = llm.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>a</p>", None)], "page_id long, html string, n_chars string")
    assert sorted(r.text for r in extracted(odd).collect()) == ["", "", "a"]
    assert extracted(pages.limit(0)).collect() == []


HALVES = [f"<p>{BODY[0]}</p>", "".join(f"<p>{p}</p>" for p in BODY[1:] * 3)]
LOST = {
    "wrapper with a noise word": f"<body><div class='layout sidebar'>{NAV}<div class='col'><h1>Title</h1>{PARAGRAPHS}</div></div>{FOOT}</body>",
    "state of the page": f"<body><div class='layout has-sidebar'><h1>Title</h1>{PARAGRAPHS}</div><div class='no-sidebar'>{NAV}</div></body>",
    "article in a wrapper": f"<body><div class='cookies-accepted'><article><h1>Title</h1>{PARAGRAPHS}</article><div class='comments'><p>{'I do not agree at all. ' * 60}</p></div></div></body>",
    "form": f"<body><form action='/'>{NAV}<div class='col'><h1>Title</h1>{PARAGRAPHS}</div></form>{FOOT}</body>",
    "ids of topics": f"<body><article><h1>Title</h1>{PARAGRAPHS.replace('<p>', '<p id=related-work>', 1)}</article></body>",
}


@pytest.mark.parametrize("name", LOST)
def test_marks_spare_what_holds_the_text(name):
    assert main_text(LOST[name]) == f"Title {TEXT}"


def test_nothing_of_the_text_is_dropped():
    assert main_text(f"<body>{NAV}<div>{HALVES[0]}</div><div>{HALVES[1]}</div>{FOOT}</body>").startswith("It was a long way")
    assert "It was a long way" in main_text(f"<body>{NAV}<article>{HALVES[1]}</article><article>{HALVES[0]}</article>{FOOT}</body>")
    assert "Notice period" in main_text(f"<article><h1>Title</h1>{PARAGRAPHS}<h2 id='notice-period'>Notice period</h2>{PARAGRAPHS}</article>")
