import html as entities
import re

import numpy as np
import pytest

from editlake.llm import bilstm
from editlake.llm.html_blocks import Blocks
from editlake.llm.html_main import extract_main_text, main_text, train
from editlake.llm.queries import op7_html_extraction


def article(page):
    """The article of the test pages by patterns: their authors mark it."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inner)]
    return " ".join(" ".join(b.split()) for b in blocks if b.split())


def test_query_against_patterns(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = op7_html_extraction(spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


def test_held_out_pages(spark, data):
    """Fitted on half of the pages, the labeller gets the articles of the others."""
    pages = spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect()
    net = train([r.html for r in pages if r.page_id % 2])
    held = [r for r in pages if r.page_id % 2 == 0]
    assert [t for t, _, _ in main_text(net, [r.html for r in held])] == [article(r.html) for r in held]


def test_pages_that_name_no_part(spark):
    """Without <article> or <main> anywhere the labeller learns from running texts in other layouts."""
    words = ["river", "stone", "old", "walls", "stand", "near", "the", "harbour", "of", "town"]
    draw = np.random.default_rng(5)
    line = lambda: " ".join(draw.choice(words, 14)).capitalize() + "."
    rows = []
    for i in range(40):
        parts = [line() for _ in range(4)]
        rows.append((i, "u", "<div class=menu><a href=/>Home</a></div><div class=content>" + "".join(f"<p>{p}</p>" for p in parts) + "</div><div class=footer>Imprint</div>", " ".join(parts)))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert sum(got[r[0]] == r[3] for r in rows) >= 38


@pytest.fixture(scope="module")
def net(spark, data):
    return train([r.html for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").limit(300).collect()])


PARTS = "Athens is old. It has been lived in for very long.|The city grew, and so did its harbour in the west.|Later it shrank, and only the hill was walled."


@pytest.mark.parametrize(
    "frame",
    [
        "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><main>{}</main><footer>&copy; 2020 Some site</footer></body>",
        "<body><div class=header>Some site</div><div class='cookie-notice'>We use cookies.</div><div class=content>{}</div><div class=sidebar>Related: other things</div><div id=footer>All rights reserved</div>",
        "<header><h1>Some site</h1></header><article>{}</article><section class=comments><div class=comment><p>I have lived there and I do not agree at all.</p></div><div class=comment><p>Very nice to read.</p></div></section><footer>Imprint</footer>",
        "<form><input name=q><button>Search</button></form><article>{}<aside>Read also: the islands</aside></article><div class='ad'>Buy now!</div><aside class=sidebar><p>Most read</p></aside>",
        "<div class='nav-bar'><a href=/>Start</a></div><div class='post-body'>{}</div><div class='comment-list'><p>First!</p><p>I was there last year and liked it a lot.</p></div><div class=newsletter><form>Your mail</form></div>",
    ],
)
def test_other_layouts(net, frame):
    parts = PARTS.split("|")
    page = "<html><head><title>Athens</title><style>p{}</style></head>" + frame.format("<h1>Athens &amp; I</h1>" + "".join(f"<p>{p}</p>" for p in parts)) + "<script>var x = '<p>no</p>';</script></html>"
    assert main_text(net, [page])[0][0] == " ".join(["Athens & I", *parts])


def test_blocks():
    found = Blocks("<div>a<b>b</b> c<br>d<p>e\n\t f&nbsp;g</div><!-- no --><p>h<p>&#x69;</p></p>j<unknown>k</unknown>").found
    assert [t for _, t, _ in found] == ["ab c d", "e f g", "h", "i", "j", "k"]
    assert Blocks("").found == Blocks("<<>").found[:0] == []


def test_head_ends_without_its_tag():
    assert [t for _, t, _ in Blocks("<html><head><title>no</title><meta charset=x><body><article><p>yes</p>").found] == ["yes"]
    assert [t for _, t, _ in Blocks("<head><title>no</title><style>p{}</style><p>yes<script>no</script>").found] == ["yes"]
    assert [t for _, t, _ in Blocks("<head><title>no</title></head>yes").found] == ["yes"]


def test_labeller_reads_both_neighbours():
    draw = np.random.default_rng(1)
    pages = [draw.normal(size=(draw.integers(1, 12), 4)) for _ in range(600)]
    labels = [((np.append(0, p[:-1, 0]) + np.append(p[1:, 1], 0)) > 0).astype(float) for p in pages]
    net = bilstm.fit(bilstm.new(4), pages[:500], labels[:500], epochs=10)
    right = np.concatenate([np.round(p) == y for p, y in zip(bilstm.predict(net, pages[500:]), labels[500:], strict=True)])
    assert right.mean() > 0.8
    assert np.allclose(bilstm.predict(net, pages[500:])[3], bilstm.predict(net, [pages[503]])[0])


def test_odd_rows(spark):
    page = "<article><p>Some words stand here, for once.</p></article><footer>c</footer>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", page, "x"), (3, "w", page, "x"), (3, "w", page, "x"), (4, "z", "<p>" + "very long " * 50_000, "x"), (4, "z", "<p>" + "many blocks <p>" * 20_000, "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 7 and {(r.page_id, r.text) for r in got if r.page_id in (1, 2)} == {(1, ""), (2, "")}
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
