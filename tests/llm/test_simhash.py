import random

import numpy as np
from brute import simhash_components

from editlake.llm.queries import op6_simhash_near_dedup
from editlake.llm.simhash import near_duplicates_removed, near_links, simhash_groups


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = simhash_components([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash_near_dedup(spark, data).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_leaves_lose_no_link(spark):
    draw = random.Random(5)
    points = {draw.getrandbits(64) for _ in range(150)} | {0, 1}
    for p in list(points):
        for _ in range(draw.randint(0, 4)):
            for b in draw.sample(range(64), draw.randint(1, 5)):
                p ^= 1 << b
            points.add(p)
    points = sorted(points)
    signed = [int(np.uint64(p).view(np.int64)) for p in points]
    links = near_links(spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3), leaf=40).collect()
    root = {s: s for s in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    near = {s: s for s in signed}
    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= 3:
                assert find(signed[i]) == find(signed[j])
                near[signed[i]] = near[signed[j]] = None
    assert all((x in {y for l in links for y in l}) == (near[x] is None) for x in signed)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(5, None), (3, ""), (4, "  "), (None, "a b c d"), (9, "A b C d"), (8, "a b c d"), (8, "a b c d"), (1, long), (2, long + " tail"), (7, "solo")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, component_id int")
    groups = simhash_groups(df)
    got = sorted(((r.doc_id, r.component_id) for r in groups.collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (None, 8), (9, 8), (8, 8), (8, 8), (1, 1), (2, 1), (7, 7)], key=str)
    assert sorted(r.doc_id for r in near_duplicates_removed(df, groups).collect()) == [1, 3, 7, 8]
    assert simhash_groups(df.limit(0)).collect() == []
