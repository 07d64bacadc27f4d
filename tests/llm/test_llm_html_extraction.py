import re
from html import unescape

import numpy as np
import pytest

from townpulse.llm import html_extraction as H
from townpulse.llm import queries as Q
from townpulse.llm.html_blocks import blocks_of
from townpulse.llm.lstm import lstm_gradients, run_lstm
from townpulse.llm.page_layouts import Layouts

import __spark_entry__ as entry_file

PROSE = [
    "The council met on Tuesday to discuss the new bridge, and most members spoke for it.",
    "Work is to begin in spring; the river will be closed to boats for six weeks.",
    "Nobody asked what it costs.",
    "A report on the old bridge, written ten years ago, had warned of rust in its northern arch.",
]


def page(body):
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


# (html, main text)
BY_HAND = [
    (
        page(
            "<header><div class='logo'>The Daily</div><nav><a href='/'>Home</a> <a href='/s'>Sport</a></nav></header>"
            "<div class='cookie-banner'>We use cookies to improve our pages. <button>Accept</button></div>"
            f"<main><article><h1>New bridge</h1><p>{PROSE[0]}<p>{PROSE[1]}"
            "<div class='ad'>Buy boats now, cheap as never before!</div>"
            f"<p>{PROSE[2]}</p></article></main>"
            "<aside class='sidebar'><h3>More</h3><ul><li><a href='/1'>Rust in arches</a></li></ul></aside>"
            "<section id='comments'><div class='comment'><p>I walked over that bridge for forty years, and it never "
            "moved at all.</p></div></section><footer>&copy; The Daily</footer>"
        ),
        ["New bridge", *PROSE[:3]],
    ),
    (
        page(
            "<div id='page'><div class='header'>City news</div><ul class='menu'><li><a href='/a'>A</a></li>"
            "<li><a href='/b'>B</a></li></ul>"
            f"<div id='content'><h2>Old &amp; new</h2><p>{PROSE[3]}</p><ul><li>{PROSE[2]}</li><li>{PROSE[1]}</li></ul>"
            f"<blockquote>{PROSE[0]}</blockquote></div>"
            "<form class='search'><label>Search the site</label></form>"
            "<div class='footer'>All rights reserved, 2020.</div></div>"
        ),
        ["Old & new", PROSE[3], PROSE[2], PROSE[1], PROSE[0]],
    ),
]


def plain_article(text):
    """The texts of the article element of the given pages, by expressions of their one layout."""
    body = re.sub(r"<script.*?</script>", "", text, flags=re.S).split("<article>")[1].split("</article>")[0]
    return " ".join(unescape(re.sub(r"</?(p|h1|br)>", " ", body).replace("<b>", "")).split())


@pytest.fixture(scope="module")
def model():
    made = Layouts(PROSE, ["home about sport", "terms and rules", "all offers of the week"], 1)
    drawn = [made.page() for _ in range(2500)]
    return H.train([b for b, _ in drawn], [y for _, y in drawn])


@pytest.mark.parametrize("number", range(len(BY_HAND)))
def test_pages_by_hand(model, number):
    text, expected = BY_HAND[number]
    blocks = blocks_of(text)
    keep = H.probabilities(model, H.Encoded([blocks])) >= 0.5
    assert [b.text for b, k in zip(blocks, keep) if k] == expected


def test_held_out_layouts(model):
    made = Layouts(PROSE[::-1], ["imprint", "log in here", "next page"], 77)
    drawn = [made.page() for _ in range(300)]
    found = H.probabilities(model, H.Encoded([b for b, _ in drawn])) >= 0.5
    wanted = np.array([x for _, y in drawn for x in y], bool)
    assert (found == wanted).mean() > 0.97


def test_each_page_is_labelled_as_if_it_were_alone(model):
    made = Layouts(PROSE, ["home"], 5)
    pages = [made.page()[0] for _ in range(30)] + [[], made.page()[0] * 400]
    together = H.probabilities(model, H.Encoded(pages))
    alone = np.concatenate([H.probabilities(model, H.Encoded([p])) for p in pages])
    assert np.allclose(together, alone, atol=1e-4)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    made = Layouts(PROSE, ["home about"], 3)
    drawn = [made.page() for _ in range(3)]
    encoded = H.Encoded([b for b, _ in drawn])
    labels = np.array([x for _, y in drawn for x in y], np.float32)
    model = {k: v.astype(np.float64) for k, v in H.new_model(5, 4, rng).items()}

    def loss():
        vectors = encoded.vectors(model)
        place, real = H.side_by_side(encoded.first, np.arange(3))
        p = H.scores_of(model, H.both_ways(model, vectors[place], real))
        y = labels[place]
        return -(np.log(np.where(y > 0, p, 1 - p)) * real).sum() / real.sum()

    grads = H.gradients(model, encoded, labels)
    used = {"path": encoded.path[0], "words": encoded.word[0]}
    for name, values in model.items():
        at = tuple(int(rng.integers(n)) for n in values.shape)
        if name in used:
            at = (int(used[name]), at[1])
        old, step = values[at].copy(), 1e-2
        values[at] = old + step
        up = loss()
        values[at] = old - step
        down = loss()
        values[at] = old
        assert np.allclose((up - down) / (2 * step), grads[name][at], rtol=0.05, atol=2e-4), name


def test_layer_against_a_loop_over_rows():
    rng = np.random.default_rng(2)
    inputs = rng.normal(size=(6, 3, 8)).astype(np.float32)
    weights = rng.normal(size=(2, 8)).astype(np.float32)
    real = np.arange(6)[:, None] < np.array([6, 2, 4])
    for backwards in (False, True):
        states, cells = run_lstm(inputs, weights, real, backwards)
        for row, steps in enumerate((6, 2, 4)):
            h = c = np.zeros(2)
            for t in reversed(range(steps)) if backwards else range(steps):
                i, f, o, g = np.split(inputs[t, row] + h @ weights, 4)
                i, f, o = (1 / (1 + np.exp(-x)) for x in (i, f, o))
                c = f * c + i * np.tanh(g)
                h = o * np.tanh(c)
                assert np.allclose(states[t, row], h, atol=1e-5) and np.allclose(cells[t, row], c, atol=1e-5)
        assert not states[~real].any()
        d_in, _ = lstm_gradients(inputs, weights, real, backwards, states, cells, np.ones_like(states))
        assert not d_in[~real].any()


def test_blocks():
    found = blocks_of("<div class='Post-Body x'>a&nbsp;b<b> c</b><p>d<p>e<br>f <a href='>'>g</a></div>h<!-- <p>i -->j")
    assert [b.text for b in found] == ["a b c", "d", "e f g", "hj"]
    assert found[2].tags == ("div", "p") and 0.1 < found[2].link_share < 0.3
    assert [b.text for b in blocks_of("<ul><li>a<li>b</ul></div></p>c<script>var t='</p>'</script>d")] == ["a", "b", "cd"]
    assert [b.text for b in blocks_of("1 < 2 <3 &lt;p&gt; <p title=\"a>b\">x<!-- open <p>y")] == ["1 < 2 <3 <p>", "x"]
    assert [b.text for b in blocks_of("<table><tr><td>a<td>b<tr><th>c</table>")] == ["a", "b", "c"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p><style>x") == []


def test_broken_markup_takes_linear_time():
    for text in ('<a "' * 100_000, "<div>" * 100_000, "<" * 200_000, "</p>" * 100_000, "<p class=" * 100_000):
        blocks_of(text + "x")
    assert len(blocks_of("<div>x" * 20_000)) == 20_000


def test_odd_pages(spark):
    article, expected = BY_HAND[0]
    many = page("<nav>home</nav><article>" + "<p>A sentence of some words, like any.</p>" * 30_000 + "</article>")
    rows = [(1, article, "u"), (1, article, "u"), (2, None, None), (3, "", "u"), (None, "<p> </p>", "u"), (4, many, "u")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string").withColumnRenamed("text", "n_kept")
    df = df.selectExpr("*", "'x' AS text", "'y' AS url", "'z' AS key")
    found = H.extract(df, carry=("url", "text", "n_kept"), layouts=400)
    assert found.columns == ["page_id", "url", "text", "n_blocks", "n_kept"]
    got = found.collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and texts[2] == texts[3] == texts[None] == "" and {r.url for r in got} == {"y"}
    assert [r.n_kept for r in got if r.page_id == 4] == [30_000]
    assert len({r.text for r in got if r.page_id == 1}) == 1
    assert H.extract(df.limit(0)).collect() == []


def test_the_query_finds_the_articles(spark):
    found = {r.page_id: r for r in Q.QUERIES["op11_html_extraction"](spark, entry_file.SMALL).collect()}
    pages = spark.read.parquet(f"{entry_file.SMALL}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        got = found[p.page_id]
        assert got.text == plain_article(p.html) and got.n_chars == len(got.text) and got.url == p.url
