"""HTML extraction: the reader of blocks, the recurrent labeller, and whole pages against what their markup says."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import html_text, queries
from waymark.llm.blocks import blocks
from waymark.llm.recurrent import Labeller

SCHEMA = "page_id long, url string, html string, text int, n_chars string, weights string"


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("", []),
        ("just text", ["just text"]),
        ("a<b>b</b>c <i> d\n\te </i>", ["abc d e"]),
        ("<p>one<p>two<br>three</p>four", ["one", "two three", "four"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("x &lt; y &amp z &copy; &#x41; &nbsp; w &nosuch; 1 < 2", ["x < y & z © A w &nosuch; 1 < 2"]),
        ("<script>if (a<b) '</p>'</script>t<style>p{}</style><!-- <p>no</p> -->u", ["tu"]),
        ("<title>no</title><textarea>no</textarea><svg><text>no</text></svg>yes", ["yes"]),
        ('<p class="a>b" title=\'<p>\'>in</p>', ["in"]),
        ("cut off <p>here</p><div cla", ["cut off", "here"]),
        ("open script <script>never closed <p>no", ["open script"]),
        ("open svg <svg><p>still text", ["open svg", "still text"]),
        ("</p></div>stray</b> ends", ["stray ends"]),
        ("<![CDATA[x]]>a<?php echo ?>b<!doctype html>c", ["abc"]),
        ("<P>Caps</P><DIV>too</DIV>", ["Caps", "too"]),
        ("<p> \n  </p><p>　x　</p>", ["x"]),
        ('<a href="x">all</a> <p>not <a>linked</a></p>', ["all", "not linked"]),
        ("quote <p title=\"never closed>text</p>more", ["quote", "text", "more"]),
    ],
)
def test_blocks(page, wanted):
    assert [block.text for block in blocks(page)] == wanted


def test_paths_and_links():
    found = blocks('<div class="postBody main-text" id=x1><ul><li><a href=1>One</a> two</ul><p>t</div><section><h2>u')
    assert [(b.node.name, b.node.parent.name, b.linked) for b in found] == [("li", "ul", 3), ("p", "div", 0), ("h2", "section", 0)]
    assert found[1].node.parent.words == ("post", "body", "main", "text", "x")


def test_deep_and_long_pages():
    deep = "<div>" * 30_000 + "deep" + "</div>" * 30_000 + "<p>after"
    assert [block.text for block in blocks(deep)] == ["deep", "after"]
    assert html_text.features(blocks(deep)).shape == (2, html_text.WIDTH)
    assert len(blocks("<p>x " * 100_000)) == 100_000


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = Labeller(5, 3, seed=2)
    model.weights = {name: value.astype(np.float64) for name, value in model.weights.items()}
    rows = [rng.normal(size=(n, 5)) for n in (4, 1, 6)]
    labels = [rng.integers(0, 2, n).astype(float) for n in (4, 1, 6)]
    _, found = model.gradients(rows, labels)
    for name, weight in model.weights.items():
        for place in rng.integers(0, weight.size, 6):
            kept, losses = weight.flat[place], []
            for change in (1e-2, -1e-2):
                weight.flat[place] = kept + change
                losses.append(model.gradients(rows, labels)[0])
            weight.flat[place] = kept
            assert found[name].flat[place] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-4)


def test_labeller_uses_both_sides_and_any_length():
    """A step is 1 if the marker came before it and another comes after it: neither side alone tells."""
    rng = np.random.default_rng(3)

    def example():
        n = int(rng.integers(3, 15))
        first, last = sorted(rng.choice(n, 2, replace=False))
        rows = np.zeros((n, 2), dtype=np.float32)
        rows[[first, last], 0] = 1
        rows[:, 1] = rng.normal(size=n)
        return rows, ((np.arange(n) >= first) & (np.arange(n) <= last)).astype(np.float32)

    rows, labels = zip(*[example() for _ in range(400)])
    model = Labeller(2, 8, seed=1)
    model.fit(rows, labels, epochs=25, rate=0.03)
    again = Labeller.load(model.dump())
    tests, wanted = zip(*[example() for _ in range(100)])
    got = again.predict([*tests, np.zeros((0, 2), dtype=np.float32)], cells=50)
    assert len(got[-1]) == 0
    assert np.mean(np.concatenate([(g >= 0.5) == w for g, w in zip(got, wanted)])) > 0.97
    for one, together in zip(tests[:5], got):
        np.testing.assert_allclose(again.predict([one])[0], together, atol=1e-5)


def marked_up(page):
    """The article of a page of the table, by its own markup."""
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in parts)
    return "\n".join(text for text in texts if text)


def test_query_returns_the_article_of_every_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    got = queries.op11_html_text(spark, sf_dir)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = sorted(tuple(row) for row in got.collect())
    wanted = [(i, u, marked_up(h), len(marked_up(h))) for i, u, h in zip(pages["page_id"], pages["url"], pages["html"])]
    assert got == sorted(wanted)


ONE = "The council met on Tuesday to discuss the new bridge, which has been planned for years. Residents spoke for two hours."
TWO = "Mayor Jones said the work would start in spring and end within a year."
REPLY = "I think this is a terrible idea and the council should listen to the people who live there."
#: Pages whose markup the table does not have: what must come out, and what must not.
OTHER_MARKUP = [
    (f"<header><a href=/>Site</a><p>Your daily source</p></header><nav><li><a href=/a>Home</a></nav><main><article><h1>Bridge plans</h1>"
     f"<p>{ONE}</p><aside>Related: <a href=x>Other bridges</a></aside><p>{TWO}</p><p>Short.</p></article><section class=comments>"
     f"<h2>2 comments</h2><div class=comment><p>{REPLY}</p></div></section></main><footer><p>&copy; 2024 Site</p></footer>",
     ["Bridge plans", ONE, TWO, "Short."]),
    (f"<div id=cookie-notice>We use cookies. <button>Accept</button></div><div class=topbar><a href=/>Home</a></div><div id=content>"
     f"<h1>Bridge plans</h1><p>{ONE}</p><p>{TWO}</p><div class=ad-box>Buy our new car today and save money now</div><p>Short.</p></div>"
     f"<div id=comments><h3>Leave a reply</h3><p>{REPLY}</p><form><label>Name</label><button>Send</button></form></div>"
     f"<div id=sidebar><h4>Most read</h4><p>{TWO}</p></div><div id=footer>All rights reserved.</div>",
     ["Bridge plans", ONE, TWO, "Short."]),
    (f"<div class=header>Logo</div><table><tr><td class=menu><a href=1>One</a><td class=main><h1>Bridge plans</h1>{ONE}<p>{TWO}"
     f"<td class=right>Ads by us</table><div class=footer>Imprint</div>", ["Bridge plans", ONE, TWO]),
    (f"<nav>a b c</nav><article><header><h1>Bridge plans</h1></header><p>{ONE}</p><blockquote>{TWO}</blockquote>"
     f"<div class=share>Share this</div><div class=advert>{TWO}</div><footer>Tags: bridge</footer><section class=comments><p>{REPLY}</p>"
     f"</section></article>", ["Bridge plans", ONE, TWO]),
    (f"<p>{ONE}<p>{TWO}<h2>More</h2><p>Short.", [ONE, TWO, "More", "Short."]),
]


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return html_text.train(spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()["html"].tolist())


def test_pages_with_other_markup(weights):
    model = Labeller.load(weights)
    right = whole = 0
    for page, wanted in OTHER_MARKUP:
        found = blocks(page)
        chosen = [b.text for b, p in zip(found, model.predict([html_text.features(found)])[0]) if p >= 0.5]
        right += sum((b.text in chosen) == (b.text in wanted) for b in found)
        whole += len(found)
    assert right >= 0.94 * whole, (right, whole)


def test_odd_pages(spark, weights):
    article = f"<nav><li><a>Menu</a></nav><article><h1>Title</h1><p>{ONE}</p></article>"
    long = f"<nav><a>Menu</a></nav><article>{f'<p>{ONE}</p>' * 3000}</article><footer>end</footer>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", article), (3, "u", article), (3, "u", article), (4, "u", long), (5, "u", "<p></p><!--")]
    pages = spark.createDataFrame([(*row, 7, "x", "y") for row in rows], SCHEMA)
    got = html_text.extract(pages, weights).toPandas()
    assert list(got.columns) == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    text = f"Title\n{ONE}"
    assert sorted(zip(got["page_id"].fillna(-1), got["text"])) == [
        (-1, text), (1, ""), (2, ""), (3, text), (3, text), (4, "\n".join([ONE] * 3000)), (5, "")
    ]
    assert (got["n_chars"] == got["text"].str.len()).all()


def test_tables_without_articles(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    learned = html_text.learn(empty, f"file://{tmp_path}/empty")
    assert html_text.extract(empty, learned).collect() == []
    plain = spark.createDataFrame([(i, "u", f"<div class=menu><a>Home</a></div><p>{ONE}</p><p>{TWO}</p>", 1, "", "") for i in range(5)], SCHEMA)
    learned = html_text.learn(plain, f"file://{tmp_path}/plain")
    found = html_text.extract(plain, learned).select(F.countDistinct("text"), F.first("text")).first()
    assert found[0] == 1 and ONE in found[1] and "Home" not in found[1]
