"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlake.llm import bilstm
from editlake.llm.common import bounded_sample, checkpointed
from editlake.llm.html_blocks import FEATURES, PATH, WORD, Blocks, features
from editlake.llm.wordbatch import chunks

#: Pages that the labeller is fitted on, characters of the longest page among them, and made-up layouts for each. These
#: are the only bounds on what is learnt from; pages are read whole.
TRAIN_PAGES, LONGEST, LAYOUTS = 300, 1 << 16, 6
#: Words of a block that counts as running text where no author marks any.
RUNNING = 8

# Names that page authors give to the parts of a page.
MAIN = (["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".main", ".content"], ["div", ".post", ".body"], ["section", ".entry"], ["div", ".story"], ["div", ".article", ".text"], ["article", ".post"], ["div", ".page", "main"], ["div", ".container", "article"])
BEFORE = (["nav"], ["header"], ["div", ".header"], ["ul", ".menu"], ["div", ".nav", ".bar"], ["div", ".cookie", ".notice"], ["div", ".cookie", ".consent", ".banner"], ["div", ".ad"], ["div", ".ads"], ["div", ".advert"], ["div", ".notice"], ["div", ".breadcrumbs"], ["form", ".search"], ["form"], ["header", "nav"], ["div", ".top", ".bar"], ["div", ".popup"], ["div", ".alert"], ["section", ".promo"], ["div", ".sponsored"])
AFTER = (["footer"], ["aside"], ["aside", ".sidebar"], ["div", ".sidebar"], ["div", ".side", ".bar"], ["section", ".comments"], ["div", ".comments"], ["div", ".comment", ".list"], ["ol", ".comment", ".list"], ["div", ".comment"], ["div", ".related"], ["div", ".newsletter", "form"], ["div", ".footer"], ["div", ".share"], ["div", ".social"], ["form"], ["div", ".ad"], ["div", ".ads"], ["div", ".advert"], ["div", ".copyright"], ["div", ".disqus", ".thread"], ["div", ".reply"], ["section", ".reviews"], ["div", ".subscribe"])
LEAVES = (["p"], ["p"], ["p"], [], ["li"], ["blockquote"], ["h2"], ["h1"], ["div"], ["pre"], ["td"])
BOILER_LEAVES = (["p"], ["p"], ["li"], ["ul", "li"], [], ["div"], ["h3"], ["button"], ["div", "p"])
AUTHOR_SAYS_MAIN, AUTHOR_SAYS_NOT = frozenset({"article", "main", ".main"}), frozenset({"nav", "header", "footer", "aside", "form", ".ad", ".ads", ".advert", ".menu", ".sidebar", ".comment", ".comments", ".cookie", ".notice"})


def _said(path: list[str]) -> int:
    return int(bool(AUTHOR_SAYS_MAIN & set(path)) and not AUTHOR_SAYS_NOT & set(path))


def _layout(draw: random.Random, texts: list[tuple], boiler: list[tuple]) -> tuple[list[tuple], list[int]]:
    """The texts of a page in another frame: any of the usual containers, boilerplate before, after and inside."""
    blocks, labels = [], []
    frame = draw.choice([[], [], ["div"], ["div", ".wrapper"], ["div", ".page"], ["div", ".container"]])

    def put(kind: list[str], mine: list[str], made_of: list[tuple], n: int) -> None:
        for _ in range(n):
            text, linked = draw.choice(made_of)
            blocks.append(([*frame, *mine, *kind, *draw.choice(BOILER_LEAVES)], text, linked))
            labels.append(0)

    every = boiler + texts
    for kind in draw.sample(BEFORE, draw.randint(0, 4)):
        put(kind, [], boiler if draw.random() < 0.6 else every, draw.randint(1, 5))
    main = draw.choice(MAIN)
    inside = sorted(draw.sample(range(1, len(texts) + 1), min(len(texts), draw.choice([0, 0, 1, 2]))))
    short = draw.random() < 0.5
    for j, (text, linked) in enumerate(texts, 1):
        if short and draw.random() < 0.7:
            text = " ".join(text.split()[: draw.randint(1, 15)])
        blocks.append(([*frame, *main, *(["h1"] if j == 1 and draw.random() < 0.7 else draw.choice(LEAVES))], text, linked))
        labels.append(1)
        if j in inside:
            put(draw.choice(BEFORE + AFTER), main, every, draw.randint(1, 3))
    for kind in draw.sample(AFTER, draw.randint(0, 5)):
        put(kind, main if draw.random() < 0.3 else [], boiler if draw.random() < 0.4 else every, draw.randint(1, 5))
    return blocks, labels


def train(pages: list[str], layouts: int = LAYOUTS) -> dict:
    """A labeller fitted on pages whose authors name their parts, and on their texts in other layouts.

    Where no author names any part, it is fitted on layouts made of the pages' running texts and their short blocks.
    """
    draw = random.Random(23)
    parsed = [b for b in (Blocks(h).found for h in pages) if b]
    named = any(_said(p) for b in parsed for p, _, _ in b)
    is_text = (lambda p, t, linked: _said(p)) if named else (lambda p, t, linked: len(t.split()) >= RUNNING and linked < 0.5)
    boiler = [(t, linked) for b in parsed for p, t, linked in b if not is_text(p, t, linked)] or [("Menu", 1.0), ("All rights reserved.", 0.0)]
    sets = [(b, [_said(p) for p, _, _ in b]) for b in parsed] if named else []
    for b in parsed:
        texts = [(t, linked) for p, t, linked in b if is_text(p, t, linked)]
        sets += [_layout(draw, texts, boiler) for _ in range(layouts)] if texts else []
    x = [features(b) for b, _ in sets]
    for rows in x:  # words tell less than places do: every other page is read without them
        if draw.random() < 0.5:
            rows[:, PATH : PATH + WORD] = 0
    net = bilstm.new(FEATURES)
    return bilstm.fit(net, x, [np.array(y, float) for _, y in sets]) if sets else net


def main_text(net: dict, pages: list[str]) -> list[tuple[str, int, int]]:
    """Text, number of blocks and number of kept blocks of each page."""
    parsed = [Blocks(h).found for h in pages]
    cuts = np.cumsum([len(b) for b in parsed])[:-1]
    x = np.split(features([block for b in parsed for block in b]), cuts)
    out = []
    for blocks, p in zip(parsed, bilstm.predict(net, x), strict=True):
        kept = [t for (_, t, _), score in zip(blocks, p, strict=True) if score >= 0.5]
        out.append((" ".join(kept), len(blocks), len(kept)))
    return out


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article of every page: blocks of text that a bidirectional LSTM labels as content, joined by a space.

    A block is the text between block-level tags, white space turned into one space, character references decoded;
    scripts, styles and the head are no blocks. The LSTM reads, for the whole page, the hashed tag path (tags, class,
    id and role words), hashed words, length and linked share of each block. It is fitted on at most `train_pages`
    pages of at most LONGEST characters (in a seeded random order of ids, one page an id) whose authors mark the
    article, or on any pages if none does, also with their texts put into other layouts, so that it learns part names
    that these pages lack. Every page is read whole.

    Returns id, url, text, n_chars (code points), n_blocks, n_kept, a row for each input row. Null and empty pages
    and pages without content give an empty text; null ids and urls and repeated rows are kept. No rows in, none out;
    other columns are ignored.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    short = pages.where(F.col(id_col).isNotNull() & (F.length(html_col) <= LONGEST)).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    ids = checkpointed(short.groupBy("id").agg(F.max(F.col("html").rlike("(?i)<(article|main)[ >]")).alias("named")))
    named = ids.where("named")
    chosen = bounded_sample((ids if named.isEmpty() else named).select("id"), "id", "pages", train_pages)
    sample = short.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html").alias("html")).collect()
    net = train([r["html"] for r in sorted(sample)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for some in chunks(iter(batch.column(2).to_pylist()), len) for r in main_text(net, some)]
            text, n, kept = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], ["id", "url", "text", "n_blocks", "n_kept"])

    kind = pages.schema[id_col].dataType.simpleString()
    made = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html")).mapInArrow(read, f"id {kind}, url string, text string, n_blocks long, n_kept long")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
