import html
import re

import numpy as np
import pytest

from chartwave.llm import html_tree as h
from tests.llm.html_cases import CASES

MODEL = h.default_model()


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 2, 0, 1])
    kind = rng.integers(0, len(h.KINDS), 8)
    model = h.Model(rng.standard_normal(len(h.NAMES)), rng.standard_normal((len(h.KINDS), len(h.KINDS), 2, 2)))
    x = rng.standard_normal((8, len(h.NAMES)))
    p, both = h.marginals(model, x, parent, kind, [np.flatnonzero(depth == d) for d in range(3)])
    total, one, pair = 0.0, np.zeros(8), np.zeros((8, 2, 2))
    for state in range(256):
        s = np.array([state >> i & 1 for i in range(8)])
        w = np.exp((s * (x @ model.node)).sum() + sum(model.pair[kind[parent[i]], kind[i], s[parent[i]], s[i]] for i in range(8) if parent[i] >= 0))
        total += w
        one += w * s
        for i in range(8):
            if parent[i] >= 0:
                pair[i, s[parent[i]], s[i]] += w
    assert np.allclose(p, one / total) and np.allclose(both, pair / total)


def test_held_out_pages():
    forest = h.Forest()
    for page in h.training_pages(200, seed=99):
        h.grow(forest, page)
    x, parent, kind, levels = h.features(forest)
    p, _ = h.marginals(MODEL, x, parent, kind, levels)
    shown = [i for i, t in enumerate(forest.text) if t and t.strip() and not forest.unseen[i]]
    assert sum((p[i] > 0.5) == bool(forest.label[i]) for i in shown) >= 0.97 * len(shown)


def test_hand_written_pages():
    lines = right = 0
    for page, wanted in CASES:
        got = h.extract(MODEL, [page])[0].split("\n")
        lines += len(wanted)
        right += sum(line in got for line in wanted) - sum(line not in wanted for line in got)
    assert len(CASES) > 30 and right >= 0.98 * lines


PARAS = [f"<p>Paragraph {i} says something, and then some more of it.</p>" for i in (1, 2, 3)]


@pytest.mark.parametrize(
    "page",
    [
        "<article><div>{0}{1}</div>{2}</article>",
        "<article>" + "<div>" * 20 + "{0}{1}" + "</div>" * 20 + "{2}</article>",
        "<article><section><h2>Head</h2>{0}</section><section>{1}</section>{2}</article>",
        '<article>{0}<div class="story-related">{1}</div>{2}</article>',
        "<body><nav><a href=x>Home</a><a href=y>News</a></nav><div>{0}{1}</div>{2}</body>",
        "<div>{0}{1}{2}</div>",
        "<div>{0}<select><option>a<option>b</select>{1}{2}</div>",
        "<div>{0}<svg><text>x</text></svg>{1}{2}</div>",
        '<article>{0}<p>see <a href="x"">this</a> too.</p>{1}{2}</article>',
        '<article>{0}<p "x>An odd one here.</p>{1}{2}</article>',
        "<article>" + "<div>" * 250 + "{0}{1}{2}" + "</div>" * 250 + "</article>",
        "<body><nav><a href=/>Home</a></nav>" + "<div>" * 3000 + "{0}{1}{2}" + "</div>" * 3000 + "<footer>&copy; me</footer></body>",
        "<article>{0}{1}{2}<form>" + "<div>" * 300 + "Mail<select><option>no</select></form></article>",
    ],
)
def test_no_paragraph_is_lost(page):
    got = h.extract(MODEL, [page.format(*PARAS)])[0]
    assert [line for line in got.split("\n") if line.startswith("Paragraph")] == [p[3:-4] for p in PARAS]
    assert "Mail" not in got and "no\n" not in got + "\n" and "me" not in got.split()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="ad">Buy now, buy more.</div>
<article><h1>A  title &amp;\n more</h1><p><b>First para.<br><p>Second &lt;para&gt; with <a href=x>a link</a> in it.</p>
<script>var t="</p>";</script><ul><li>Point one.<li>Point two.</ul><!-- no --><p>Tom & Jerry &copy; 2020.</article>
<aside class=sidebar><h3>Related</h3><a href=q>Other story</a></aside>
<section id="comments"><div class="comment"><p>I liked this a lot. Thank you.</p></div></section>
<form><label>Mail</label><input></form><footer>&copy; site &middot; All rights kept.</footer></body></html>"""


def test_a_page_with_everything():
    assert h.extract(MODEL, [PAGE]) == [
        "A title & more\nFirst para.\nSecond <para> with a link in it.\nPoint one.\nPoint two.\nTom & Jerry © 2020."
    ]


def test_odd_pages(spark):
    rows = [(1, "u", PAGE, 0), (None, None, None, 0), (2, "v", "", 0), (3, "w", "<", 0), (3, "w", "<p <b", 0), (4, "z", "<div>" * 5000 + "x", 0),
            (5, "y", PAGE[: len(PAGE) // 2], 0), (6, "l", "<article><p>" + "word. " * 60_000 + "</p></article>", 0)]
    out = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), MODEL)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[None] == "" and by[2] == "" and by[6].count("word.") == 60_000
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string"), MODEL).count() == 0


def plain_article(page):
    """The blocks between the article tags of the tables' simple pages, by string splitting alone."""
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = re.split(r"</?(?:p|h1|div|ul|li)>", re.sub(r"<script>.*?</script>|<!--.*?-->", "", inner, flags=re.S))
    texts = [" ".join(html.unescape(re.sub(r"</?\w+[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_articles_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = h.extract(MODEL, [r.html for r in rows])
    assert sum(text == plain_article(r.html) for r, text in zip(rows, got)) >= 0.99 * len(rows)


SAID = [f"Paragraph {i} says something of substance here, and then it goes on for a while longer." for i in range(1, 7)]
SHEET = [f"<p>{p}</p>" for p in SAID]
STATED = ("post-content ad-free", "ad-free", "post ad", "content no-ads", "notice-board", "entry newsletter-signup-enabled", "has-comments", "comments-open",
          "share-enabled", "no-sidebar", "main with-sidebar", "post hide-share", "promo-story", "related-article")


@pytest.mark.parametrize("name", STATED)
@pytest.mark.parametrize("k", [2, 6])
def test_one_class_does_not_empty_a_page(name, k):
    page = f'<html><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><div class="{name}">{"".join(SHEET[:k])}</div><footer>&copy; 2020 The Site. All rights reserved.</footer></body></html>'
    assert h.extract(MODEL, [page]) == ["\n".join(SAID[:k])]


@pytest.mark.parametrize("core", ["<div class=content>{}</div>", "<article>{}</article>", "<div class=post>{}</div>"])
@pytest.mark.parametrize("side", ["<div class=sidebar><p>{0}</p></div>", "<div class='side'><h3>More</h3><p>{0}</p></div>", "<div id=sidebar><p>{0}</p><p>{0}</p></div>", "<div class=widget><p>{0}</p></div>"])
def test_a_plain_sidebar_beside_the_text_goes(core, side):
    side = side.format("Read more of our stories about the harbour and the people who work there every day of the year.")
    for inside in (core.format("".join(SHEET[:4])) + side, side + core.format("".join(SHEET[:4]))):
        page = f"<body><header><a href=/>Site</a></header><div class=wrap>{inside}</div><footer>&copy; me</footer></body>"
        assert h.extract(MODEL, [page]) == ["\n".join(SAID[:4])]


@pytest.mark.parametrize("core", ["<div class=content>{}</div>", "<article>{}</article>"])
@pytest.mark.parametrize("tags", ["<div class=tags>Tags: <a href=/s>ships</a></div>", "<p class=tags>Tags: <a href=/s>ships</a>, <a href=/t>trade</a></p>", '<div class="post-tags"><span>Tags:</span> <a href=/s>ships</a> <a href=/q>quay</a></div>'])
def test_a_line_of_tags_goes(core, tags):
    page = f"<body><nav><a href=/>H</a><a href=/b>B</a></nav>{core.format(''.join(SHEET[:3]) + tags)}<footer>&copy; x</footer></body>"
    assert h.extract(MODEL, [page]) == ["\n".join(SAID[:3])]


@pytest.mark.parametrize("name", ["single-post", "entry-body", "td-post-content", "article__body", "rich-text", "field-item", "mw-parser-output", "markdown-body", "blog-post-full", "news-detail", "c-article-body", "story-body__inner"])
def test_common_layouts(name):
    nav, foot = "<nav><a href=/>Home</a> <a href=/x>World</a> <a href=/y>Sport</a></nav>", "<footer><p>&copy; 2021 Harbour News</p></footer>"
    alone = f'<html><body>{nav}<div id="page"><div class="{name}"><h1>Harbour opens</h1>{"".join(SHEET[:4])}</div></div>{foot}</body></html>'
    beside = f'<html><body>{nav}<div class="container"><div class="row"><div class="col-8 {name}"><h1>Harbour opens</h1>{"".join(SHEET)}</div><div class="col-4 sidebar"><h4>Latest</h4><ul><li><a href=/1>One story</a></li><li><a href=/2>Another story</a></li></ul><p>Sign up to get the best of our work every week.</p></div></div></div>{foot}</body></html>'
    remarked = f'<html><body>{nav}<div class="{name}"><h1>Harbour opens</h1>{"".join(SHEET[:5])}<div class="share-bar"><a href=/t>Tweet</a><a href=/f>Post</a></div></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>I think this is quite wrong, and I said so before.</p></div><div class="comment"><p>Well done to all of them.</p></div></div>{foot}</body></html>'
    assert h.extract(MODEL, [alone, beside, remarked]) == ["\n".join(["Harbour opens", *SAID[:k]]) for k in (4, 6, 5)]
