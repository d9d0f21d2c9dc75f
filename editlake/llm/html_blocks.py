"""Blocks of text in a page, with the tags around them and their features."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from zlib import crc32

import numpy as np

from editlake.llm.wordbatch import Words, mixed

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What a head may hold: any other element ends it, whether `</head>` stands there or not.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: An open paragraph ends where one of these begins.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

PATH, WORD = 64, 16
FEATURES = PATH + WORD + 4
_NAMES = re.compile(r"[a-z]+")


class Blocks(HTMLParser):
    """found: (tag path tokens, text, share of its characters inside links) for each block in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.text, self.linked, self.links, self.hidden = [], [], [], 0, 0, 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = [token for _, tokens in self.open for token in tokens]
            self.found.append((path, text, min(1.0, self.linked / max(1, sum(map(len, self.text))))))
        self.text, self.linked = [], 0

    def pop(self, upto: int) -> None:
        for tag, _ in self.open[upto:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.open[upto:]

    def end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.pop(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag in VOID:
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == "p":
                        self.pop(i)
                        break
                    if self.open[i][0] not in INLINE:
                        break
        names = [f".{n}" for key, value in attrs if key in ("class", "id", "role") and value for n in _NAMES.findall(value.lower())]
        self.open.append((tag, [] if tag in INLINE else names if tag in ("html", "body") else [tag, *names]))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop(i)
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.text.append(data)
            self.linked += len(data) if self.links else 0


def _signs(seeds: np.ndarray, width: int) -> np.ndarray:
    return ((mixed(seeds)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


_TABLE = _signs(np.arange(1 << 12, dtype=np.uint64) + np.uint64(977), WORD)
_KNOWN: dict[tuple, np.ndarray] = {}


def _path_vector(path: list[str]) -> np.ndarray:
    """Sum of hashed vectors of the tokens; the two innermost levels count twice."""
    key = tuple(path)
    if key not in _KNOWN:
        if len(_KNOWN) > 50_000:
            _KNOWN.clear()
        distinct = list(dict.fromkeys(path)) or [""]
        vectors = _signs(np.array([crc32(t.encode()) for t in distinct], np.uint64), PATH)
        _KNOWN[key] = vectors.sum(axis=0) / np.sqrt(len(distinct))
    return _KNOWN[key]


def features(blocks: list[tuple]) -> np.ndarray:
    """One row for each (path, text, linked share) of one or more pages; the place in the page is left to the network."""
    x = np.zeros((len(blocks), FEATURES), np.float32)
    if not blocks:
        return x
    x[:, :PATH] = [_path_vector(p) for p, _, _ in blocks]
    words = Words([t.encode("utf-8", "surrogatepass") for _, t, _ in blocks], lower=True)
    vectors = _TABLE[(words.hashes() >> np.uint64(50)).astype(np.int64) % len(_TABLE)]
    full = np.flatnonzero(words.n)
    x[full, PATH : PATH + WORD] = np.clip(np.add.reduceat(vectors, words.first[full]) / np.sqrt(words.n[full, None]), -2, 2)
    x[:, PATH + WORD] = np.log1p(words.n) / 4
    x[:, PATH + WORD + 1] = [linked for _, _, linked in blocks]
    x[:, PATH + WORD + 2] = [t[-1] in ".!?…:;\"'”»)" for _, t, _ in blocks]
    x[:, PATH + WORD + 3] = 1
    return x
