import random

import numpy as np
from brute import words
from pyspark.sql import functions as F

from editlake.llm import minhash
from editlake.llm.minhash import MEMBERS, minhash_groups, shingle_sets, sketch

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())


def brute(rows, percent=80):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def groups(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_groups(df, **more).collect()}


def near_copies(draw, families, members, edits):
    """Families of texts that differ from a base by edits; some families lie just below and above the threshold."""
    rows = []
    for f in range(families):
        base = [f"w{draw.randrange(400)}" for _ in range(60)]
        for _ in range(members):
            w = list(base)
            for at in draw.sample(range(60), draw.randrange(edits)):
                w[at] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_families_against_brute_force(spark):
    rows = near_copies(random.Random(3), 12, 14, 9)
    want = brute(rows)
    assert groups(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want
    assert len({c for _, c, _ in want.values()}) > 12


def test_one_large_family_below_the_threshold(spark):
    """All texts share tables with nearly all others, and only a few of them are linked: every round is needed."""
    rows = near_copies(random.Random(4), 1, 150, 16)
    want = brute(rows)
    assert groups(spark.createDataFrame(rows, SCHEMA)) == want
    assert 1 < len({c for _, c, _ in want.values()}) < 150


def test_labels_of_paths_and_stars(spark):
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(90)] + [("s0", f"s{i}") for i in range(1, 9)] + [("b", "a"), ("a", "c")]
    got = {r.name: r.label for r in minhash.dense_labels(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: {"p": "p000", "s": "s0"}.get(x[0], "a") for two in links for x in two}


def test_sets_with_too_many_own_shingles_go(spark):
    live = spark.createDataFrame([(b"a", 10), (b"b", 10), (b"c", 10), (b"d", 1)], "name binary, n long")
    sets = spark.createDataFrame([(b"a", [*range(10)]), (b"b", [*range(8), 20, 21]), (b"c", [*range(7), 30, 31, 32]), (b"d", [40]), (b"other", [30, 31])], "name binary, made array<long>")
    assert sorted(bytes(r.name) for r in minhash._unlike(live, sets, 80).collect()) == [b"c", b"d"]


def test_bits_leave_out_no_similar_pair(spark):
    draw = np.random.default_rng(2)
    rows = []
    for k in range(400):
        a = np.unique(draw.integers(0, 1 << 63, draw.integers(1, 3000))).astype(np.uint64)
        b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.15 * draw.random()], draw.integers(0, 1 << 63, int(0.15 * draw.random() * len(a))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        rows.append((k, len(a), len(b), minhash.bits_of(a).tolist(), minhash.bits_of(b).tolist(), bool(100 * both >= 80 * (len(a) + len(b) - both))))
    df = spark.createDataFrame(rows, "k int, n long, its_n long, bits array<long>, its_bits array<long>, similar boolean")
    got = df.select("n", "similar", minhash._may_be_similar(80).alias("may")).collect()
    assert all(r.may for r in got if r.similar) and sum(not r.may for r in got if not r.similar and r.n < 500) > 0


def test_threshold_is_exact(spark):
    """8 of 10 shingles link, 7 of 9 do not; upper case and white space are no difference."""
    a = " ".join(f"a{i}" for i in range(10))
    rows = [(1, a), (2, "A0\t a1\n" + a[6:] + " more"), (5, "q r s t u v w x y"), (6, "q r s t u v w x z")]
    assert groups(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    pair = [(1, "a b c d e f g h i"), (2, "a b c d e f g h j")]  # 7 of 9
    assert groups(spark.createDataFrame(pair, SCHEMA)) == {1: (8, 1, True), 2: (8, 2, True)}
    pair = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i")]  # 8 of 9
    assert groups(spark.createDataFrame(pair, SCHEMA)) == {1: (9, 1, True), 2: (8, 1, False)}


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}z{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "word"), (5, "WORD"), (6, "a b"), (6, "a b"), (None, "a b"), (7, long), (8, long + " tail"), (None, "only null")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", n long, label string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash_groups(df).collect()))
    n = len(shingle_set(long))
    assert got == [(0, 1, 0, True), (0, 1, 6, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (7, n, 7, True), (8, n + 1, 7, False)]
    assert minhash_groups(df.limit(0)).count() == 0
    assert groups(df.where("doc_id < 4")) == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True)}


def test_copies_are_one_point(spark):
    """A third of all rows is one text: its group costs one point, and the members still get their label."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text that many rows have").otherwise(F.concat(F.lit("text "), F.md5(F.col("id").cast("string")), F.lit(" "), F.col("id"))).alias("text"))
    got = groups(df)
    assert all(got[i][1] == (0 if i % 3 == 0 else i) for i in range(3000))


def test_sketches_are_pairs_of_two_collections():
    sets = list(shingle_sets([b"a b c d", b"A B  C D", b"", b"e"], 2))
    keys = sketch(sets)
    assert keys.shape == (4, 2 * MEMBERS) and (keys[0] == keys[1]).all() and not keys[2].any()
    assert len(np.unique(keys[[0, 3]])) == 4 * MEMBERS
