"""Main-text extraction on pages written by rule with other seeds, and on the tables' pages."""

import html
import re

import numpy as np
import pytest

from anamnesis.llm import extraction
from anamnesis.llm.boosting import fit
from anamnesis.llm.html import Page
from anamnesis.llm.page_templates import Writer


@pytest.fixture(scope="module")
def model():
    return extraction.trained()


def test_trees_learn_an_exclusive_or():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(4000, 3))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.3)).astype(float)
    trees = fit(rows[:3000], labels[:3000], trees=40, depth=3)
    assert ((trees.log_odds(rows[3000:]) > 0) == labels[3000:]).mean() > 0.95


def test_decoding_is_hierarchical():
    parent = [-1, 0, 1, 1, 0, 4]
    kept = extraction.decode(parent, [0, -1, 2, -3, -5, 4])
    assert kept == [True, True, True, False, False, False]


def test_unseen_templates(model):
    pages = [Writer(50_000 + i).page() for i in range(150)]
    found = extraction.extract([re.sub(r' data-y="[\d:]*"', "", p) for p in pages], model)
    both = missed = extra = 0
    for page, text in zip(pages, found):
        read = Page(page)
        want = {*read.text([m == "1" for m in ["0", *read.mark[1:]]]).split("\n")}
        got = {*text.split("\n")}
        both, missed, extra = both + len(want & got), missed + len(want - got), extra + len(got - want)
    assert both / (both + missed) > 0.97 and both / (both + extra) > 0.97


def article_of(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_the_tables_pages(spark, sf):
    from anamnesis.llm.q_extraction import op5_main_text

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op5_main_text(spark, sf).collect()
    assert len(out) == len(pages)
    right = sum(r.text == article_of(pages[r.page_id].html) for r in out)
    assert right >= 0.98 * len(out)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in out)


def test_odd_pages(spark, model):
    pages = [
        None, "", "   ", "<", "<p", "<!-- open", "<script>var a = '<p>text</p>'", "plain text without elements &amp; more",
        "<article><h1>T</h1><p>One&nbsp;&lt;two&gt;  three\n four.<p>Next <b>bold</b>word</article><footer>&copy; x</footer>",
        "<div>" * 3000 + "deep" + "</div>" * 3000, "<article>" + "<p>Some words stand here.</p>" * 20_000 + "</article>", '<p title="open quote>text</p>',
    ]
    rows = spark.createDataFrame([(i, f"u{i}", p, 1) for i, p in enumerate(pages)] + [(8, "u8", pages[8], 1)], "page_id long, url string, html string, x int")
    out = extraction.extract_pages(rows.toDF("page_id", "url", "html", "HTML"), model).orderBy("page_id").collect()
    assert [r.text for r in out[:7]] == ["", "", "", "<", "", "", ""]
    assert out[7].text == "plain text without elements & more"
    assert out[8].text == out[9].text == "T\nOne <two> three four.\nNext boldword"
    assert out[11].text.count("\n") == 19_999
    assert extraction.extract_pages(rows.limit(0), model).count() == 0


def best_set(parent, odds):
    """All sets without an element below a dropped one, the best by sum."""
    n, best = len(parent), (0.0, [])
    for bits in range(1 << (n - 1)):
        kept = [True] + [bool(bits >> k & 1) for k in range(n - 1)]
        if all(kept[parent[i]] or not kept[i] for i in range(1, n)):
            best = max(best, (sum(odds[i] for i in range(1, n) if kept[i]), kept), key=lambda x: x[0])
    return best[0]


@pytest.mark.parametrize("seed", range(20))
def test_decoding_equals_an_enumeration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 12))
    parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
    odds = [float(x) for x in rng.normal(size=n).round(2)]
    kept = extraction.decode(parent, odds)
    assert all(kept[parent[i]] or not kept[i] for i in range(1, n))
    assert sum(odds[i] for i in range(1, n) if kept[i]) == pytest.approx(best_set(parent, odds))


SAY = [
    "The old mill stood by the river for two hundred years, and nobody knew who had built it.", "In spring the water rose, and the wheel turned day and night.",
    "Farmers came from villages around with their grain; some of them walked for hours.", "When the last miller died, his daughter sold the stones and moved to the city.",
    "Today a small museum tells the story, and children may turn a model of the wheel.",
]
TEXT = "\n".join(SAY)
MENU = '<ul class="nav"><li><a href="/">Home</a><li><a href="/n">News</a><li><a href="/c">Contact</a></ul>'
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in SAY)
#: Pages that no rule wrote, with the text that is expected.
HAND_MADE = {
    "bare text before an advert": (f"<h1>The mill</h1>{' '.join(SAY)}<div class='ad'>Buy flour now!</div>", "The mill\n" + " ".join(SAY)),
    "plain text, then a paragraph": (f"{SAY[0]} {SAY[1]}<p>{SAY[2]} {SAY[3]}</p>", f"{SAY[0]} {SAY[1]}\n{SAY[2]} {SAY[3]}"),
    "unclosed svg": (f"<article><p>{SAY[0]} {SAY[1]}</p><svg width=1><p>{SAY[2]} {SAY[3]}</p></article>", f"{SAY[0]} {SAY[1]}\n{SAY[2]} {SAY[3]}"),
    "unclosed select": (f"<article><p>{SAY[0]} {SAY[1]}</p><select><p>{SAY[2]} {SAY[3]}</p></article>", f"{SAY[0]} {SAY[1]}\n{SAY[2]} {SAY[3]}"),
    "one unclosed and one closed select": (f"<article><p>{SAY[0]} {SAY[1]}</p><select><p>{SAY[2]} {SAY[3]}</p><select><option>x</select></article>", f"{SAY[0]} {SAY[1]}\n{SAY[2]} {SAY[3]}"),
    "hidden words": (f"<article><p>{SAY[0]} <span hidden>secret words</span>{SAY[1]}</p>{PARAGRAPHS}</article>", f"{SAY[0]} {SAY[1]}\n{TEXT}"),
    "inline advert": (f"<article><p>{SAY[0]} <span class='advert'>Buy our flour today</span></p>{PARAGRAPHS}</article>", f"{SAY[0]}\n{TEXT}"),
    "inline markup": (f"<article><p><span class='dropcap'>T</span>{SAY[0][1:]} <b class='x'>{SAY[1]}</b></p>{PARAGRAPHS}</article>", f"{SAY[0]} {SAY[1]}\n{TEXT}"),
    "a blog": (
        f"<html><head><title>x</title></head><body class='home'><div id='top'><a href='/'>My blog</a></div><div id='nav'>{MENU}</div><div class='post' id='post-12'><h2>The mill</h2>"
        f"<div class='entry'>{PARAGRAPHS}</div></div><div id='comments'><h3>2 comments</h3><ol><li class='comment'><p>Nice story, I was there last year.</p></li></ol></div>"
        "<div id='footer'>Powered by a press. All rights reserved.</div></body></html>", "The mill\n" + TEXT,
    ),
    "tables for layout": (f"<body><table><tr><td class='menu'>{MENU}</td><td class='content'><h1>The mill</h1>{PARAGRAPHS}</td></tr></table></body>", "The mill\n" + TEXT),
    "a newspaper": (
        f"<body><header><nav>{MENU}</nav></header><main><section class='story'><h1>The mill</h1>{PARAGRAPHS}<aside class='newsletter'><form><p>Get our letters</p><input></form></aside>"
        "</section><section class='related'><h3>More</h3><ul><li><a href='/a'>A bridge</a><li><a href='/b'>A tower</a></ul></section></main><footer><p>© 2024 The paper</p></footer></body>", "The mill\n" + TEXT,
    ),
    "sections without names": (
        f"<div id=c><div><h2>One</h2><p>{SAY[0]} {SAY[1]}</p></div><div><h2>Two</h2><p>{SAY[2]} {SAY[3]}</p></div></div>", f"One\n{SAY[0]} {SAY[1]}\nTwo\n{SAY[2]} {SAY[3]}",
    ),
    "a plain division": (f"<div><h2>The mill</h2><p>{SAY[0]} {SAY[1]}</p><p>{SAY[2]} {SAY[3]}</p></div>", f"The mill\n{SAY[0]} {SAY[1]}\n{SAY[2]} {SAY[3]}"),
    "a plain division in a page": (f"<html><body><div><h2>The mill</h2><p>{SAY[0]} {SAY[1]}</p><p>{SAY[2]} {SAY[3]}</p></div></body></html>", f"The mill\n{SAY[0]} {SAY[1]}\n{SAY[2]} {SAY[3]}"),
    "a plain division after a notice": (
        f"<div class='cookie-notice'><p>We use cookies. You may refuse them.</p><button>No</button></div><div><h2>The mill</h2><p>{SAY[0]} {SAY[1]}</p><p>{SAY[2]} {SAY[3]}</p></div>",
        f"The mill\n{SAY[0]} {SAY[1]}\n{SAY[2]} {SAY[3]}",
    ),
    "three paragraphs in a plain division": (f"<div><h2>The mill</h2><p>{SAY[0]}</p><p>{SAY[1]} {SAY[2]}</p><p>{SAY[3]}</p></div>", f"The mill\n{SAY[0]}\n{SAY[1]} {SAY[2]}\n{SAY[3]}"),
    "a paragraph with a hostile name": (f"<article><h1>The mill</h1><p>{SAY[0]}</p><p class='share-price'>{SAY[1]} {SAY[2]}</p><p>{SAY[3]}</p></article>", f"The mill\n{SAY[0]}\n{SAY[1]} {SAY[2]}\n{SAY[3]}"),
    "sections in a main element": (
        f"<body><nav>{MENU}</nav><main><h1>The mill</h1><section><h2>Then</h2><p>{SAY[0]}</p><p>{SAY[1]}</p></section><section><h2>Now</h2><p>{SAY[4]}</p></section></main><footer>© us</footer></body>",
        f"The mill\nThen\n{SAY[0]}\n{SAY[1]}\nNow\n{SAY[4]}",
    ),
    "old style": (f"<body><div class='navbar'>{MENU}</div><h1>The mill</h1>{'<br><br>'.join(SAY)}<hr><div class='footer'>Copyright the author</div></body>", "The mill\n" + " ".join(SAY)),
}


@pytest.mark.parametrize("name", HAND_MADE)
def test_pages_written_by_hand(model, name):
    page, want = HAND_MADE[name]
    assert extraction.extract([page], model) == [want]


def test_many_unclosed_elements(model):
    page = "<article>" + "<svg><select>" * 5000 + PARAGRAPHS + "</article>"
    assert extraction.extract([page], model) == [TEXT]
