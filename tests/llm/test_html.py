"""HTML blocks and the chain field: brute-force decoding, gradients, held-out layouts, the given pages."""

import html
import re
from itertools import product

import numpy as np
import pytest

from shoplens.llm import html_text
from shoplens.llm.html_blocks import Block, leaf_blocks
from shoplens.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def field():
    return html_text.trained()


def test_blocks():
    page = ("<html><head><title>T &amp; t</title><style>p{}</style></head><body><!-- no --><p>a <b>b<br>c<p>d&nbsp; &lt;e&gt;"
            "<script>var x='</p>';</script><ul><li>one<li><a href=x>two</a> three</ul><div class='Big-Box x2' id=sideBar>\n in\n</div>tail")
    got = leaf_blocks(page)
    assert [b.text for b in got] == ["T & t", "a b c", "d <e>", "one", "two three", "in", "tail"]
    assert got[4].link_chars == 3 and got[5].names == {"big", "box", "x", "side", "bar"}
    assert got[3].tags[-1] == "li" and got[4].tags.count("li") == 1 and got[2].tags.count("p") == 1
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<p>  </p><script>x</script>") == []
    assert [b.text for b in leaf_blocks("plain &amp text")] == ["plain & text"]


def test_text_of_embedding_elements_is_kept():
    page = ("<article><p>where <math><mi>x</mi></math> is small</p><object><p>in object</p></object><map name=m><p>in map</p></map>"
            "<canvas>drawn</canvas><p>a <svg><text>label</text></svg> b</p><noscript><p>plain</p></noscript><video src=v>film</video></article>")
    assert [b.text for b in leaf_blocks(page)] == ["where x is small", "in object", "in map", "drawn", "a label b", "plain", "film"]


@pytest.mark.parametrize("start, end", [("<noscript><div class=ad>", "</noscript>"), ("<object><ul>", "</object>"), ("<svg><div>", "</svg>"),
                                        ("<template><div>", "</template>"), ("<iframe><ul>", "</iframe>")])
def test_end_tags_close_what_is_open_inside(start, end):
    got = leaf_blocks(f"<article>{start}{end}<p>after</p></article>")
    assert [(b.text, b.tags, b.names) for b in got] == [("after", ("article", "p"), frozenset())]


def test_never_rendered_text_is_dropped():
    page = ("<p>a <template><p>no</p><div>no</div></template><math><mi>x</mi><annotation>no</annotation></math>"
            "<svg><desc>no</desc></svg><script>no</script> b</p>")
    assert [b.text for b in leaf_blocks(page)] == ["a", "x b"]


def test_viterbi_is_the_best_of_all_labelings():
    rng = np.random.default_rng(3)
    names = [f"n{k}" for k in range(6)]
    for _ in range(30):
        field = html_text.ChainField({f"name={n}": tuple(rng.normal(size=2)) for n in names}, rng.normal(size=(2, 2)))
        blocks = [Block("t", (), frozenset(rng.choice(names, 2)), 0) for _ in range(rng.integers(1, 7))]
        def score(labels):
            emit = sum(field.weights[f"name={n}"][l] for b, l in zip(blocks, labels) for n in b.names)
            return emit + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))
        best = max(product((0, 1), repeat=len(blocks)), key=score)
        assert field.labels(blocks) == [bool(l) for l in best]


def test_fit_learns_steps_between_labels():
    block = {True: Block("x", ("p",), frozenset({"m"}), 0), False: Block("x", ("p",), frozenset({"o"}), 0),
             None: Block("x", ("p",), frozenset(), 0)}
    pages = [([block[v] for v in (True, None, None)], [True] * 3), ([block[v] for v in (False, None, None)], [False] * 3)] * 20
    field = html_text.fit(pages)
    assert field.labels([block[True], block[None]]) == [True, True] and field.labels([block[False], block[None]]) == [False, False]


def test_held_out_layouts(field):
    right = total = 0
    for page, labels in labelled_pages(150, seed=99):
        found = field.labels(leaf_blocks(page))
        right += sum(a == m for a, (_, m) in zip(found, labels))
        total += len(labels)
    assert right / total > 0.99


def test_labels_must_fit_blocks():
    with pytest.raises(ValueError):
        html_text.trained([("<p>a</p>", [("b", True)])])


PAGES = {
    """<body><div id="header">Site</div><div id="menu"><ul><li><a href=1>x</a></li></ul></div><div id="content"><h2>Head</h2>
    <p>Alpha beta gamma.</p><p>B.</p><form><p>Subscribe to our letter</p></form><div class="comments"><p>reader says hello.</p>
    </div></div><div id="sidebar"><p>About me.</p></div><div id="footer"><p>All rights reserved.</p></div></body>""":
        "Head\n\nAlpha beta gamma.\n\nB.",
    """<div class="cookie-banner"><p>We use cookies.</p></div><article><h1>T</h1><p>Body &amp; text here.</p><aside>promo</aside>
    <div class="advert">Buy.</div><p>More.</p></article><section id="comments"><p>nice</p></section>""":
        "T\n\nBody & text here.\n\nMore.",
}


def test_kinds_of_pages(field):
    for page, text in PAGES.items():
        assert html_text.main_text(page, field) == text


def test_given_pages(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumnRenamed("url", "text")
    got = html_text.extracted(pages, field=field).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(source)
    for r in got:
        inside = re.search("<article>(.*?)</article>", source[r.page_id], re.S).group(1).replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_empty_null_and_repeated(spark, field):
    rows = [(1, None), (1, None), (2, ""), (None, "<article><p>x</p></article>")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, html string"), field=field).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("1", ""), ("2", ""), ("None", "x")]
    assert html_text.extracted(spark.createDataFrame([], "html string"), field=field).count() == 0
    blocks = html_text.labelled_blocks(spark.createDataFrame(rows, "page_id long, html string"), field=field).collect()
    assert [(b.nth, b.text, b.tags, b.main) for b in blocks] == [(0, "x", "article/p", True)]


@pytest.mark.parametrize("page, texts", [
    ("<p>a<![foo[x]]>b</p>", ["ab"]), ("<p>a</p><!-- never closed <p>hidden</p>", ["a"]),
    ("<!DOCTYPE html [ <!ENTITY x 'y'> ]><p>t</p>", ["t"]), ("<p>a<!x>b<?pi c>d</p>", ["abd"]),
    ("<p>x<![CDATA[zz]]>y</p>", ["xy"]), ("<p>a<? never closed", ["a"]), ("<div>a<!-- c --!>b</div>", ["ab"]),
])
def test_malformed_declarations(page, texts):
    assert [b.text for b in leaf_blocks(page)] == texts


@pytest.mark.parametrize("page", ["<div>x" * 20000, "<b>x</i>" * 20000, "<span>x<p>y" * 20000, "<div><b>" * 20000 + "</i>x" * 20000])
def test_open_elements_in_linear_time(page):
    import time
    start = time.perf_counter()
    blocks = leaf_blocks(page)
    assert time.perf_counter() - start < 5 and blocks
    deepest = max(blocks, key=lambda b: len(list(b.tags)))
    assert deepest.parent and deepest.inner_tags


def test_malformed_page_in_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<![foo[x]]>b</p>"), (2, "v", "<article><p>Fine text of a page.</p></article>")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert set(got) == {1, 2}
