"""Main text: held-out pages of the generator, awkward markup, and agreement with a count of all labellings."""

from __future__ import annotations

import itertools
import math
import time

from worldlog.llm import html, html_pages


def test_held_out_pages():
    model, right, all_ = html.default_model(), 0, 0
    for page in html_pages.labelled_pages(200, seed=99):
        tree = html.parse(page)
        for (node, _), p in ((r, html.default_model().marginals(tree)[r[0]]) for r in tree.runs):
            right += (p >= 0.5) == (html.labels_of(tree)[node] == 1)
            all_ += 1
    assert model.tables
    assert right >= 0.98 * all_


def test_marginals_are_those_of_all_labellings():
    model = html.default_model()
    page = html.parse("<body><nav><ul><li><a href=x>a b</a></li></ul></nav><article><p>one two three</p><p>four</p></article></body>")
    own = [sum(model.weights.get(f, 0.0) for f in found) for found in html.features(page)]
    total, content = 0.0, [0.0] * len(page.nodes)
    for labels in itertools.product((0, 1), repeat=len(page.nodes)):
        weight = math.exp(sum(o * x for o, x in zip(own, labels, strict=True)))
        for i, node in enumerate(page.nodes[1:], 1):
            weight *= model.tables[html.kind(node.tag)][labels[node.parent]][labels[i]]
        total += weight
        for i, x in enumerate(labels):
            content[i] += weight * x
    for p, c in zip(model.marginals(page), content, strict=True):
        assert abs(p - c / total) < 1e-6


def test_blocks_and_references(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>x  y\n z<br>w&eacute;</p><script>no()</script><p>Second <b>bold</b>.</p></article><footer>&copy; all</footer>"
    assert html.main_text(page, html.default_model()) == "A & B\nx y z wé\nSecond bold."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "plain words")]
    pages = spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].n_chars == len(got[1].text) > 0
    assert got[2].text == got[3].text == ""
    assert len(got) == 5
    assert html.extract(pages.limit(0)).count() == 0


def test_deep_and_odd_pages_take_linear_time():
    deep = "<div>" * 60_000 + "x"
    cases = [deep, "<table>" + deep + "<tr></tr>" * 30_000, "<a '" * 100_000, "<p title=\"" * 60_000, "<svg>" * 60_000, "<b <b " * 60_000, "<!-- " * 60_000, '<p "' * 30_000 + ">", "</li></section>" * 40_000]
    for source in cases:
        began = time.perf_counter()
        html.parse(source)
        assert time.perf_counter() - began < 6, source[:20]


def test_markup_that_is_cut_off():
    text = lambda source: " ".join(x for _, x in html.parse(source).runs)
    assert text("<p>a<!-- b > c") == "a"
    assert text("<p>a<b title='x > y'>c</b> d") == "ac d"
    assert text("<p>a > b <i>c</i") == "a > b c</i"
    assert text("<li>a<ul><li>b</ul>c</li>d") == "a b c d"


def test_repeated_and_long_pages(spark):
    long_ = "<body><article>" + "".join(f"<p>Sentence number {i} of the article says a little.</p>" for i in range(5_000)) + "</article></body>"
    pages = spark.createDataFrame([(1, "u", long_), (1, "u", long_)], "page_id long, url string, html string")
    got = html.extract(pages).collect()
    assert len(got) == 2
    assert got[0] == got[1]
    assert got[0].text.count("\n") == 4_999


RAW = [
    "<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>if(a<b){x()}</script>", "<SCRIPT type='a>b'>x<y</Script >", "<style>a<b{c:d}</style>",
    "<script>document.write('<p>no</p><script>')</script>", "<script>a<!-- b</script>", "<textarea>x<y <p></textarea>", "<noframes><p <b</noframes>",
    "<iframe>a<b</iframe>", "<script></script>", "<script>s='<a href=\"'</script>", "<style>/* <!-- */</style>",
]


def test_raw_text_hides_nothing_after_it():
    text = lambda source: " ".join(x for _, x in html.parse(source).runs)
    for raw in RAW:
        assert text(f"{raw}<p>one</p>") == "one", raw
        assert text(f"<p>one</p>{raw}<p>two</p>") == "one two", raw
        assert text(f"<p>one {raw} two</p>{raw}{raw}<p>three</p>{raw}") == "one two three", raw
        assert text(f"<head><title>a<b</title>{raw}</head><body><p>one</p>") == "one", raw
    assert text("<p>a</p><script>x<y") == "a"
    assert text("<p>a</p><script>x<y</p>") == "a"


def test_articles_with_scripts_at_every_place():
    """Pages of the generator keep their main text when scripts are put before, within and after their blocks."""
    model = html.default_model()
    for page in html_pages.labelled_pages(60, seed=7):
        want = html.main_text(page, model)
        places = [i for i in range(len(page)) if page.startswith(("<p", "</p>", "<h1", "</body>"), i)]
        for raw in RAW[:4]:
            changed = page
            for i in reversed(places):
                changed = changed[:i] + raw + changed[i:]
            assert html.main_text(changed, model) == want, raw
