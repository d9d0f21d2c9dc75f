"""Plain re-statements of the contracts, on lists of rows."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(rows, window=20):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_words, n_removed, sha256)}."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), (doc, i)) < (doc, i):
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def simhash(text):
    import xxhash

    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, radius=3):
    """(doc_id, text) -> {doc_id: (fingerprint, component_id)}."""
    fp = {d: simhash(t) for d, t in rows}
    root = {f: f for f in fp.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    points = list(root)
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d in sorted(fp):
        least.setdefault(find(fp[d]), d)
    return {d: (f"{f:016x}", least[find(f)]) for d, f in fp.items()}


def shingles(text, k=5):
    w = words((text or "").lower())
    return {" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def leaks(docs, items, threshold=0.8):
    """(doc_id, text), (item_id, text) -> {(doc_id, item_id): (n, shared)}."""
    out = {}
    wanted = {i: shingles(t) for i, t in items}
    for d, t in docs:
        mine = shingles(t)
        for i, s in wanted.items():
            if s and len(mine & s) >= threshold * len(s) - 1e-9:
                out[d, i] = (len(s), len(mine & s))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: size} -> {source: target} by resharing what is above a limit until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cut = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in cut)
        total = sum(weight[s] for s in order if s not in cut)
        over = {s for s in order if s not in cut and left * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in cut else left * weight[s] / total for s in order}
        cut |= over
