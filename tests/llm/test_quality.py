import zlib

import numpy as np

from editlake.llm.quality import fit, quality_scores, scores
from editlake.llm.queries import op5_quality_classifier


def test_held_out_accuracy(spark, data):
    got = {r.doc_id: r for r in op5_quality_classifier(spark, data).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    assert set(got) == docs
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    again = {r.doc_id: r.score for r in op5_quality_classifier(spark, data).collect()}
    assert max(abs(again[d] - r.score) for d, r in got.items()) < 1e-9


def test_odd_rows(spark):
    docs = [(i, ("good plain words here " if i % 2 else "b$d j$nk ### ") * 9, "x") for i in range(200)] + [(None, "good plain words", "x"), (500, None, "x"), (501, "", "x"), (502, "plain words " * 200_000, "x"), (3, "good", "x")]
    labels = [(i, i % 2, "x") for i in range(0, 160)] + [(None, 1, "x"), (170, None, "x"), (9999, 1, "x"), (1, 0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, y string")
    got = quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int, text string")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all((r.predicted == 1) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and 160 <= r.doc_id < 200)
    none = quality_scores(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_scores(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, text string")).collect() == []


def test_temperature_calibrates():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 6))
    y = (draw.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    p = scores(fit(x[:4000], y[:4000]), x[4000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (p >= low) & (p < low + 0.25)
        assert abs(p[part].mean() - y[4000:][part].mean()) < 0.08


def test_scores_against_a_plain_restatement(spark):
    """Word vectors, pooling and network by loops over words, for the network that the same rows give."""
    from collections import defaultdict

    import editlake.llm.quality as Q
    from editlake.llm.wordbatch import Words

    draw = np.random.default_rng(4)
    good, bad = ["tree", "house", "river", "walks", "slowly", "over"], ["%%", "click", "buy", "now", "x1", "!!"]
    rows = [(i, " ".join(draw.choice(good if i % 2 else bad, int(draw.integers(0, 30))))) for i in range(120)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_scores(df, labels).collect()}

    place, sign = Q.index_vectors()
    number = {w: int(Q._hashed(Words([w.encode()]))[0]) for w in good + bad}

    def index(w):
        v = np.zeros(Q.DIM)
        for j in range(Q.NONZERO):
            v[place[number[w], j]] += sign[number[w], j]
        return v

    context = defaultdict(lambda: np.zeros(Q.DIM))
    for _, t in rows:
        w = t.split()
        for i in range(len(w)):
            for j in range(max(0, i - Q.REACH), min(len(w), i + Q.REACH + 1)):
                if i != j:
                    context[number[w[i]]] += index(w[j])
    unit = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in context.items()}

    def pool(t):
        w = t.split()
        if not w:
            return np.zeros(3 * Q.DIM)
        v = np.array([unit.get(number[x], np.zeros(Q.DIM)) for x in w])
        pairs = sum((index(a) * index(b) for a, b in zip(w, w[1:], strict=False)), np.zeros(Q.DIM))
        return np.concatenate([v.mean(axis=0), v.std(axis=0), pairs / len(w)])

    known = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    x = {i: pool(t) for i, t in rows}
    order = sorted(known)
    net = fit(np.array([x[i].astype(np.float32) for i in order], float), np.array([i % 2 for i in order]))
    for i, _ in rows:
        z = (x[i] - net["mu"]) / net["sd"]
        logit = np.tanh(z @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"][0]
        assert abs(1 / (1 + np.exp(-logit / net["heat"])) - got[i]) < 2e-3


def test_repeated_ids_teach_once(spark):
    """However many rows share an id, at most `train_rows` vectors come to the driver."""
    docs = [(1, f"good plain words {i}") for i in range(500)] + [(i, ("good plain " if i % 2 else "b$d j$nk ") * 9) for i in range(2, 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 100)], "doc_id long, quality int")
    got = quality_scores(df, labels).collect()
    assert len(got) == len(docs) and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95
