"""Quality classifier: random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlake.llm.common import bounded_sample, checkpointed, text_of
from editlake.llm.wordbatch import Words, chunks, mixed

#: Words are hashed to WORDS rows; each has DIM coordinates. Index vectors have NONZERO signs; contexts reach REACH words to either side.
WORDS, DIM, NONZERO, REACH = 1 << 15, 32, 2, 2
#: Most labelled rows that the network is fitted on, taken in a seeded random order of their ids; the only bound on what is learnt from.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 30, 256, 0.01, 1e-4
THRESHOLD = 0.3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each hashed word the coordinates that are not zero, and their signs."""
    at = np.arange(WORDS * NONZERO, dtype=np.uint64) + np.uint64(1)
    h = mixed(at * np.uint64(0x9E3779B97F4A7C15)).reshape(WORDS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def _hashed(words: Words) -> np.ndarray:
    return (words.hashes() >> np.uint64(40)).astype(np.int64) % WORDS


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the index vectors around each hashed word, over all texts of a task."""
    place, sign = index_vectors()
    total = np.zeros(WORDS * DIM)
    texts = (t for b in batches for t in b.column(0).cast(pa.binary()).to_pylist())
    for some in chunks(texts, len, 1 << 20):
        words = Words(some)
        w, text = _hashed(words), words.text_of_word()
        cells, signs = [], []
        for step in range(1, REACH + 1):
            same = text[step:] == text[:-step]
            left, right = w[:-step][same], w[step:][same]
            for a, b in ((left, right), (right, left)):
                for j in range(NONZERO):
                    cells.append(a * DIM + place[b, j])
                    signs.append(sign[b, j])
        total += np.bincount(np.concatenate(cells), np.concatenate(signs), WORDS * DIM)
    table = total.reshape(WORDS, DIM).astype(np.int64)
    used = np.flatnonzero(table.any(axis=1))
    for i in range(0, len(used), 4096):
        part = used[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(table[part, j]) for j in range(DIM))], ["word", *(f"c{j}" for j in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors of the hashed words, counted over every text of `docs`; whole numbers, so any order of adding gives the same.

    The table is WORDS x DIM numbers, whatever the input: it comes to the driver and goes out with the tasks.
    """
    names = [f"c{j}" for j in range(DIM)]
    parts = docs.select(text_of(text_col).alias("text")).mapInArrow(_context_counts, "word long, " + ", ".join(f"{c} long" for c in names))
    summed = parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    table = np.zeros((WORDS, DIM))
    table[summed["word"].to_numpy()] = np.stack([summed[c].to_numpy() for c in names], axis=1) if summed.num_rows else 0
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, and mean product of the index vectors of neighbouring words."""
    place, sign = index_vectors()
    index = np.zeros((WORDS, DIM), np.float32)
    for j in range(NONZERO):
        index[np.arange(WORDS), place[:, j]] += sign[:, j]
    out = []
    for some in chunks(iter(texts), len, 1 << 19):
        words = Words(some)
        w, text, full = _hashed(words), words.text_of_word(), np.flatnonzero(words.n)
        part = np.zeros((len(some), 3 * DIM), np.float32)
        if len(full):
            at, n = words.first[full], words.n[full, None].astype(np.float32)
            v, x = vectors[w], index[w]
            next_to = np.zeros_like(x)
            next_to[:-1] = x[:-1] * x[1:] * (text[:-1] == text[1:])[:, None]
            mean = np.add.reduceat(v, at) / n
            part[full, :DIM] = mean
            part[full, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / n - mean * mean, 0))
            part[full, 2 * DIM :] = np.add.reduceat(next_to, at) / n
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, 3 * DIM), np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """A two-layer network by Adam, and the temperature that suits a tenth of the rows kept apart."""
    draw = np.random.default_rng(7)
    if len(y) < 20 or len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return {"constant": float(p)}
    mu, sd = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mu) / sd
    apart = draw.random(len(y)) < 0.1
    if not 0 < apart.sum() < len(y):
        apart[0] = True
    zt, yt = z[~apart], y[~apart].astype(float)
    p = {"w1": draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, s, t = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(yt))
        for i in range(0, len(order), BATCH):
            xb, yb, t = zt[order[i : i + BATCH]], yt[order[i : i + BATCH]], t + 1
            h = np.tanh(xb @ p["w1"] + p["b1"])
            e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - yb) / len(yb)
            back = np.outer(e, p["w2"]) * (1 - h * h)
            g = {"w1": xb.T @ back + DECAY * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ e + DECAY * p["w2"], "b2": np.array([e.sum()])}
            for k in p:
                m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * 0.9**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    net = p | {"mu": mu, "sd": sd}
    logit, yv = _logit(net, x[apart]), y[apart]
    heats = np.geomspace(0.25, 8, 60)
    loss = [np.mean(np.logaddexp(0, np.where(yv == 1, -logit, logit) / c)) for c in heats]
    return net | {"heat": float(heats[int(np.argmin(loss))])}


def _logit(net: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh((x - net["mu"]) / net["sd"] @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"][0]


def scores(net: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in net:
        return np.full(len(x), net["constant"])
    return 1 / (1 + np.exp(-np.clip(_logit(net, x) / net["heat"], -40, 40)))


def _pool_with(vectors: np.ndarray, net: dict | None):
    """Rows (any columns, text) -> the same columns and the pooled vector as bytes, or its score."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist(), vectors)
            made = pa.array([r.tobytes() for r in x], pa.binary()) if net is None else pa.array(scores(net, x.astype(float)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "made"])

    return pool


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", key_col: str | None = None) -> DataFrame:
    """Scores every text with the probability that its quality label is 1.

    A word's vector is the sum of the sparse random index vectors of the words around it, over all texts. A text is
    the pooled vectors of its words. A two-layer network is fitted on at most `train_rows` labelled rows whose
    crc32(id as text) mod 5 is not 0, and calibrated by a temperature; only texts go into a score.

    Returns id, held_out (that remainder is 0), score (0 to 1), predicted (1 if score >= threshold, else 0), a row for
    each input row. Null and empty texts have no words and get a score like any text. Null ids count as empty text for
    held_out. Ids with labels that contradict each other, null labels and labels without a document teach nothing;
    of rows that share an id one teaches (that of the smallest pooled vector), so at most `train_rows` come to the driver;
    with fewer than 20 usable labels or one class all scores are the smoothed share of label 1. No documents, no
    rows; other columns are ignored, but `key_col`, if given, is returned after the id.
    """
    fold = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    vectors = word_vectors(docs, text_col)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("most")).where("y = most and id is not null")
    sample = checkpointed(bounded_sample(known.where(fold != 0).select("id", F.col("y").cast("int").alias("y")), "id", "quality", train_rows))
    pooled_rows = given.join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(_pool_with(vectors, None), f"id {kind}, y int, made binary")
    taught = pooled_rows.groupBy("id", "y").agg(F.min("made").alias("made")).toArrow()
    rows = sorted(zip(taught["id"].to_pylist(), taught["made"].to_pylist(), taught["y"].to_pylist(), strict=True))
    x = np.array([np.frombuffer(r[1], np.float32) for r in rows], float).reshape(len(rows), 3 * DIM)
    net = fit(x, np.array([r[2] for r in rows], int))
    keys = [key_col] if key_col else []
    kinds = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    texts = docs.select(F.col(id_col).alias("id"), *keys, text_of(text_col).alias("text"))
    made = texts.mapInArrow(_pool_with(vectors, net), f"id {kind}{kinds}, made double")
    return made.select(F.col("id").alias(id_col), *keys, (fold == 0).alias("held_out"), F.col("made").alias("score"), (F.col("made") >= threshold).cast("int").alias("predicted"))
