"""Operators against plain loops, properties of splits and samples, and plans."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from editlake.functions import sequence as Q
from editlake.functions.metrics import correlation_p_value, kendall_tau, regression_metrics
from editlake.operators import clustering as C
from editlake.operators import models as L
from editlake.operators import pairs as P
from editlake.operators import relational as R
from editlake.operators import sampling, splits
from editlake.operators.joins import lookup_pairs, points_in_intervals
from editlake.operators.ordering import exact_rank, md5_key
from editlake.sources.tables import write_table


def plan(df):
    return df._jdf.queryExecution().toString()


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def sets():
    draw = random.Random(4)
    base = [frozenset(draw.sample(range(40), draw.randint(1, 9))) for _ in range(40)]
    return dict(enumerate([frozenset(x for x in s if draw.random() < 0.9) | frozenset(draw.sample(range(40), 1)) for s in base * 3]))


def as_df(spark, sets):
    return spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, items array<int>")


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_set_similarity_join(spark, sets, least):
    got = {(r.id_a, r.id_b) for r in P.set_similarity_join(as_df(spark, sets), "id", "items", least).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= least - 1e-12}


def test_leader_clusters_equal_the_sequence(spark, sets):
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.4]
    near = {k: {b if a == k else a for a, b in links if k in (a, b)} for k in sets}
    left, want = sorted(sets, key=lambda k: (-len(near[k]), k)), {}
    while left:
        leader = left[0]
        for k in [leader, *near[leader]]:
            want.setdefault(k, leader)
        left = [k for k in left if k not in want]
    nodes = spark.createDataFrame([(k, -len(near[k])) for k in sets], "id long, order int")
    got = {r.id: r.leader for r in C.leader_clusters(nodes, spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    got = {r.id: r.label for r in C.components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50, 60: 60}


def test_sequence_pairs(spark):
    draw = random.Random(3)
    seqs = sorted({"".join(draw.choice("ACGU") for _ in range(draw.choice((5, 6)))) for _ in range(150)} | {"A"})
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    distance = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99
    for d in (1, 2, 3):
        got = {(r.seq_a, r.seq_b, r.distance) for r in P.hamming_pairs(df, "seq", d).collect()}
        assert got == {(a, b, distance(a, b)) for a, b in itertools.combinations(seqs, 2) if distance(a, b) <= d}
    snv = {(r.key_a, r.key_b) for r in P.snv_pairs(df.withColumn("key", F.col("seq")), "key", "seq").collect()}
    assert snv == {(a, b) for a in seqs for b in seqs if distance(a, b) == 1} == {(b, a) for a, b in snv}


def test_pairs_of_a_core(spark):
    fragments = spark.createDataFrame([(i, "c" if i < 30 else "d", f"x{i}.y") for i in range(33)], "mol_id long, core string, chain string")
    molecules = spark.createDataFrame([(i, float(i) if i != 5 else None) for i in range(33)], "mol_id long, mw double")
    got = {(r.mol_a, r.mol_b) for r in P.mmp_pairs(fragments, molecules, max_mw_delta=2.5, min_mols=5, cap=None).collect()}
    assert got == {(a, b) for a, b in itertools.combinations([i for i in range(30) if i != 5], 2) if b - a <= 2.5}
    capped = P.capped_cores(fragments, 10).groupBy("core").count().collect()
    assert {r["core"]: r["count"] for r in capped} == {"c": 10, "d": 3}


def test_points_in_intervals(spark):
    draw = random.Random(8)
    points = [(i, draw.choice("xy"), draw.randint(1, 5000)) for i in range(300)]
    spans = [(i, draw.choice("xy"), lo := draw.randint(1, 5000), lo + draw.choice((0, 3, 999, 2500))) for i in range(60)]
    p, s = spark.createDataFrame(points, "id long, chrom string, pos long"), spark.createDataFrame(spans, "tx long, chrom string, lo long, hi long")
    got = {(r.id, r.tx) for r in points_in_intervals(p, s).collect()}
    assert got == {(a, b) for a, c, x in points for b, d, lo, hi in spans if c == d and lo <= x <= hi}
    assert not any(n in plan(points_in_intervals(p, s)) for n in ("CartesianProduct", "BroadcastNestedLoopJoin"))


def test_missing_vector_is_an_error(spark):
    pairs, vectors = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    with pytest.raises(Exception, match="no vector"):
        lookup_pairs(pairs, vectors, "a", "b", "k", "v").collect()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"g{i % 13}" if i % 50 else None, float(i % 97), i % 3 == 0) for i in range(1000)], "id long, grp string, value double, flag boolean").cache()


def test_exact_rank(rows):
    got = exact_rank(rows, md5_key("s", "id"), ["id"], "r").select("id", "r", "r_of").collect()
    import hashlib

    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"s|{i}".encode()).hexdigest(), i))
    assert {x.id: x.r for x in got} == {i: k for k, i in enumerate(order)} and {x.r_of for x in got} == {1000}


def test_splits_are_partitions(rows):
    for df in (splits.random_split(rows, ["id"]), splits.random_split(rows, ["id"], strata=("grp",)), splits.quantile_split(rows, ["id"], "value", 5), splits.holdout_split(rows, F.col("flag"), ["id"]), splits.ordered_split(rows, "value", ["id"]), splits.entity_split(rows.na.fill("none", ["grp"]), "grp")):
        got = df.collect()
        assert sorted(r.id for r in got) == list(range(1000)) and {r.split for r in got} <= {"train", "val", "test"}
    sizes = {r["split"]: r["count"] for r in splits.random_split(rows, ["id"]).groupBy("split").count().collect()}
    assert sizes == {"train": 700, "val": 150, "test": 150}


def test_group_split_keeps_groups(rows):
    got = splits.group_split(rows, ["grp"])
    assert got.count() == rows.where("grp is not null").count()
    assert got.groupBy("grp").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    few = splits.few_shot_split(rows.where("grp is not null"), "grp", ["id"], 4).collect()
    assert len(few) == 980


def test_group_allocation_equals_the_loop(rows):
    import hashlib

    groups = splits.group_allocation(rows.where("grp is not null"), ["grp"], "s").collect()
    size = {r.grp: r.size for r in groups}
    total, train, val, want = sum(size.values()), 0, 0, {}
    for g in sorted(size, key=lambda g: hashlib.md5(f"s|{g}".encode()).hexdigest()):
        if train < total * 70 // 100:
            want[g], train = "train", train + size[g]
        elif val < total * 15 // 100:
            want[g], val = "val", val + size[g]
        else:
            want[g] = "test"
    assert {r.grp: r.split for r in groups} == want


def test_tiny_strata_train(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, value double")
    assert {r.split for r in splits.quantile_split(df, ["id"], "value", 3).collect()} == {"train"}
    assert splits.random_split(df.limit(0), ["id"]).collect() == []


def test_matched_sampling(rows):
    df = rows.withColumn("label", F.col("flag").cast("int")).withColumn("s", F.col("id") % 4)
    got = sampling.matched_negatives(df, "label", ["id"], 100, ["s"]).groupBy("s").count().collect()
    positives = {r["s"]: r["count"] for r in df.where("label = 1").groupBy("s").count().collect()}
    assert {r["s"]: r["count"] for r in got} == {s: 100 * n // sum(positives.values()) for s, n in positives.items()}
    assert sampling.sample_fraction(rows, ["id"], 10).count() == 100


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


GOLD = [
    (lambda: Q.find_all(F.col("s"), "AUG"), "AUGAUG", [0, 3]),
    (lambda: Q.find_all(F.col("s"), "AUG"), "", []),
    (lambda: Q.find_all(F.col("s"), "AUG"), "AU", []),
    (lambda: Q.kozak_score(F.col("s")), "CCCCCC", 0.0),
    (lambda: Q.gc_content(F.col("s")), "", 0.0),
    (lambda: Q.reverse_complement(F.col("s")), "acgtn", "NACGU"),
    (lambda: Q.translate_codons(F.col("s")), "AUGAAAUAACCC", "MK"),
    (lambda: Q.translate_codons(F.col("s")), "AU", ""),
    (lambda: Q.translate_codons(F.col("s")), "AUGNNN", "MX"),
    (lambda: Q.seq_validate(F.col("s")), "ACGN", False),
    (lambda: Q.is_drach(F.col("s")), "UGGMCUU", True),
    (lambda: F.size(Q.find_uorfs(F.col("s"))), "AUGAAAUAA", 1),
    (lambda: F.size(Q.find_uorfs(F.col("s"))), "AUGUAA", 0),
    (lambda: F.size(Q.find_are_motifs(F.col("s"))), "AUUUAUUUA", 2),
    (lambda: F.array_join(F.transform(Q.find_are_motifs(F.col("s")), lambda m: F.concat(m.kind, F.lit("@"), m.position.cast("string"))), ","), "CCAUUUACAUUUAUUUUUU", "class_I@2,class_I@8,class_III@13"),
    (lambda: Q.parse_edit(F.col("s")).isNull(), "a>b", True),
    (lambda: Q.region_label(F.col("s").cast("int")), "105", "CDR3"),
    (lambda: Q.region_label(F.col("s").cast("int")), "129", None),
    (lambda: Q.index_array(F.col("s")), "1;x;;3", [1, 3]),
]


@pytest.mark.parametrize("k", range(len(GOLD)))
def test_golden_rows(spark, k):
    column, given, want = GOLD[k]
    assert one(spark, column(), s=given) == want


@pytest.mark.parametrize(("a", "b", "want"), [("ACGU", "ACGU", ("none", 4, "", "", 0)), ("ACGU", "AGGU", ("SNV", 1, "C", "G", 1)), ("ACGU", "UCGA", ("complex", 0, "ACGU", "UCGA", 2)), ("ACGU", "ACGGU", ("insertion", 3, "", "G", 1)), ("ACGU", "CGU", ("deletion", 0, "A", "", 1)), ("ACG", "ACGUU", ("insertion", 3, "", "UU", 2)), ("", "A", ("insertion", 0, "", "A", 1))])
def test_edits(spark, a, b, want):
    assert tuple(one(spark, Q.extract_edit(F.col("a"), F.col("b")), a=a, b=b))[:5] == want


@pytest.mark.parametrize(("text", "want"), [("A50G", ("H", "A", 49, "G")), ("L:A50G", ("L", "A", 49, "G")), ("HA50G", ("H", "A", 49, "G")), ("AL50G", ("L", "A", 49, "G")), ("A50", None), ("", None), (None, None)])
def test_mutations(spark, text, want):
    got = one(spark, Q.parse_mutation(F.col("s")), s=text)
    assert (tuple(got) if got else None) == want


def test_metrics(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0), ("t", 2.0, 2.0), ("t", 4.0, None), ("t", 3.0, 5.0), ("u", 1.0, 1.0), ("t", float("nan"), 1.0)], "task string, y_true double, y_pred double")
    got = {r.task: r for r in regression_metrics(df, ["task"]).collect()}
    assert got["t"].n == 3 and got["t"].mae == 1.0 and got["t"].r2 == pytest.approx(1 - 5 / 2) and got["u"].r2 is None
    tau = kendall_tau(spark.createDataFrame([("a", float(y), float(p)) for y, p in ((1, 1), (2, 3), (3, 2), (4, 4), (4, 5))], "g string, y_true double, y_pred double"), ["g"]).first()
    assert tau.kendall == pytest.approx(7 / (9 * 10) ** 0.5, abs=1e-6)
    assert correlation_p_value(0.5, 20) == pytest.approx(0.0248, abs=2e-4) and correlation_p_value(0.1, 2) is None


def test_models(spark):
    draw = random.Random(1)
    data = [(i, v := [draw.gauss(0, 1) for _ in range(4)], 2 * v[0] - v[2] + 1) for i in range(300)]
    df = spark.createDataFrame(data, "id long, v array<double>, y double")
    model = L.ridge(df, "v", "y", alpha=1e-3)
    assert list(model.coefficients) == pytest.approx([2, 0, -1, 0], abs=1e-2)
    assert max(abs(r.f - r.y) for r in L.predict(model, df, "v", "f").collect()) < 0.05
    projected, shares = L.pca_projection(df, "v", 4)
    assert sum(shares) == pytest.approx(1) and len(projected.first().components) == 4
    clusters = L.kmeans_clusters(spark.createDataFrame([(i, [10.0 * (i % 3), 0.1 * (i % 5), 1.0]) for i in range(90)], "id long, v array<double>"), "v", 3, components=2)
    assert clusters.select((F.col("id") % 3).alias("m"), "cluster").distinct().count() == 3


def test_dictionary(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "x string")
    words = R.dictionary(df, "x")
    assert {r.value: r.id for r in words.collect()} == {"a": 0, "b": 1, "c": 2}
    more = R.dictionary(df.union(spark.createDataFrame([("aa",)], "x string")), "x", words)
    assert {r.value: r.id for r in more.collect()} == {"a": 0, "b": 1, "c": 2, "aa": 3}
    back = R.decode(R.encode(df, words.where("value <> 'c'"), "x", "i"), words, "i", "x").collect()
    assert sorted(r.x for r in back) == ["Unknown", "Unknown", "a", "b", "b"]


def test_zero_is_a_value(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0)], "value double, other double")
    assert [r.v for r in R.resolve_columns(df, {"v": ["value", "other"]}).collect()] == [0.0, 5.0]


def test_unknown_format_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown format"):
        write_table(spark.range(1), "/nowhere", format="xls")


def test_plans_stay_native(spark):
    from editlake.plans import all_queries

    queries, _ = all_queries()
    for name in ("extract_edit", "kmer_features", "translate_codons", "apply_mutations", "kozak_score", "tanimoto_join", "mmp_pairs_by_core", "hamming_neighbors"):
        text = plan(queries[name](spark, "/root/testdata/sf0.001"))
        assert not any(n in text for n in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")), name


def test_cluster_splits_share_no_cluster(spark):
    from editlake.plans import all_queries

    run = lambda n: all_queries()[0][n](spark, "/root/testdata/sf0.001")
    both = run("split_by_cluster").join(run("butina_clusters").withColumnRenamed("id", "vec_id"), "vec_id")
    assert both.groupBy("leader").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()


def whole_sequences(spark):
    """pair_id -> (a, b) of the view text_pairs, by plain string work."""
    out = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        letters = "".join("ACGU"[(ord(c) - 97) % 4] for c in (r.text or "").lower() if "a" <= c <= "z")
        if letters:
            p = r.doc_id % 47
            out[r.doc_id] = letters, letters[:p] + ("G" + letters[p + 1 :] if r.doc_id % 2 == 0 else letters[p + 1 :])
    return out


def leaders_by_loop(spark, seqs):
    """Sequence -> its leader: longest first, then by the hash that stands for it, one by one."""
    hashed = spark.createDataFrame([(s,) for s in sorted(seqs)], "seq string").select("seq", F.xxhash64("seq").alias("id")).collect()
    order = sorted(((-len(r.seq), r.id, r.seq) for r in hashed))
    mers = {s: {s[i : i + 8] for i in range(len(s) - 7)} for s in seqs}
    leader = {}
    for _, name, s in order:
        if s not in leader:
            leader[s] = name
            for _, _, other in order:
                if other not in leader and mers[s] and mers[other] and jaccard(mers[s], mers[other]) >= 0.7 - 1e-12:
                    leader[other] = name
    return leader


def split_by_loop(groups):
    """group -> split of a list of groups, one for each row: 70 and 15 percent of the rows, whole groups in md5 order."""
    sizes = {g: groups.count(g) for g in set(groups)}
    n, out, before, reached = len(groups), {}, 0, None
    for g in sorted(sizes, key=lambda g: (hashlib.md5(f"split|{g}".encode()).hexdigest(), g)):
        if before < n * 70 // 100:
            out[g] = "train"
        else:
            reached = before if reached is None else reached
            out[g] = "val" if before - reached < n * 15 // 100 else "test"
        before += sizes[g]
    return out


def test_cluster_splits_against_loops(spark):
    from editlake.plans import all_queries

    run = lambda n: all_queries()[0][n](spark, "/root/testdata/sf0.001").collect()
    led = {r.id: r.leader for r in run("butina_clusters")}
    want = split_by_loop(list(led.values()))
    assert {r.vec_id: r.split for r in run("split_by_cluster")} == {i: want[k] for i, k in led.items()}
    pairs = whole_sequences(spark)
    leader = leaders_by_loop(spark, {s for two in pairs.values() for s in two if s})
    followed = split_by_loop([leader[a] for a, _ in pairs.values()])
    assert {r.pair_id: r.split for r in run("split_by_sequence_similarity")} == {i: followed[leader[a]] for i, (a, _) in pairs.items()}
    alone = split_by_loop(list(leader.values()))
    first = lambda a, b: min((alone[leader[s]] for s in (a, b)), key=["train", "val", "test"].index)
    assert {r.pair_id: r.split for r in run("split_pairs_by_cluster_priority")} == {i: first(a, b) for i, (a, b) in pairs.items() if b}


@pytest.mark.parametrize("least", [0.4, 0.7, 0.9])
def test_similar_candidates_are_few_and_complete(spark, least):
    """Long sets over few items: the counted prefix leaves little more than the true pairs, and all of them."""
    draw = random.Random(8)
    base = [draw.sample(range(3000), draw.randint(150, 400)) for _ in range(30)]
    sets = {}
    for s in base:
        for share in (0.0, 0.05, 0.15, 0.3):
            sets[len(sets)] = frozenset(x for x in s if draw.random() >= share) | frozenset(draw.sample(range(3000), int(len(s) * share)))
    true = {(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= least - 1e-12}
    tokens = P.set_tokens(as_df(spark, sets), "id", "items")
    found = {(min(r.x, r.y), max(r.x, r.y)) for r in P.similar_candidates(tokens, "id", least).collect()}
    assert true <= found and len(found) <= 3 * len(true)
    got = {(r.id_a, r.id_b): r.similarity for r in P.set_similarity_join(as_df(spark, sets), "id", "items", least).collect()}
    assert got == {p: pytest.approx(jaccard(sets[p[0]], sets[p[1]])) for p in true}


def test_pairs_once_equal_the_smallest_core(spark):
    draw = random.Random(6)
    mols = spark.createDataFrame([(i, draw.uniform(0, 30), None if i % 11 == 0 else [i]) for i in range(60)], "mol_id long, mw double, more array<int>")
    frags = spark.createDataFrame(sorted({(draw.randrange(60), f"c{draw.randrange(12)}", f"{draw.choice('xyz')}.{draw.choice('uvw')}") for _ in range(400)}), "mol_id long, core string, chain string")
    for cap in (None, 12):
        frags = frags.groupBy("mol_id", "core").agg(F.max("chain").alias("chain")) if cap else frags
        every = P.mmp_pairs(frags, mols, 10, 3, cap)
        want = sorted(map(tuple, P.smallest_core(every).select("mol_a", "mol_b", "core", "chain_a", "chain_b").collect()))
        once = P.mmp_pairs(frags, mols, 10, 3, cap, once=True, carry=("more",))
        assert sorted(map(tuple, once.select("mol_a", "mol_b", "core", "chain_a", "chain_b").collect())) == want and len(want) > 100
        edits = lambda df: sorted(map(tuple, P.with_edits(df).select("mol_a", "mol_b", "edit", "num_cuts").collect()))
        assert edits(once) == edits(P.smallest_core(every))
        assert all(r.more_a in (None, [r.mol_a]) and r.more_b in (None, [r.mol_b]) for r in once.collect())


def test_masks_count_what_expanded_rows_count(spark):
    """130 groups are three words; counts over masks equal counts over the expanded rows."""
    from editlake.operators import aggregates as A

    draw = random.Random(7)
    member = {i: {f"g{draw.randrange(130):03d}" for _ in range(draw.randint(1, 60))} for i in range(40)}
    df = spark.createDataFrame([(i, g) for i, gs in member.items() for g in gs] + [(0, None)], "mol_id long, g string")
    masks, words, groups = P.membership_masks(df, "mol_id", "g")
    ids = {r.id: r.value for r in groups.collect()}
    assert len(words) == -(-len(ids) // 64) == 3
    two = [(a, b, f"e{(a + b) % 5}") for a, b in itertools.combinations(member, 2)]
    side = lambda s: masks.select(F.col("mol_id").alias(s), *(F.col(w).alias(f"{w}_{s}") for w in words))
    pairs = spark.createDataFrame(two, "a long, b long, edit string").join(side("a"), "a").join(side("b"), "b").select("edit", *P.shared_groups(words)).withColumn("rows", P.mask_size(words))
    rows = [(e, g) for a, b, e in two for g in member[a] & member[b]]
    assert {r.edit: r.n for r in A.frequency(pairs, "edit", weight="rows").collect()} == {e: sum(x == e for x, _ in rows) for e in {e for e, _ in rows}}
    got = {(r.edit, ids[r.id]): r.n for r in A.group_counts(pairs, words, ["edit"]).collect()}
    assert got == {k: rows.count(k) for k in set(rows)}
    some = [3, 63, 64, 127, 129]
    got = {r.edit: (r.n_properties, r.n) for r in A.counts_of_groups(pairs, words, "edit", some).collect()}
    names = {ids[i] for i in some if i in ids}
    assert got == {e: (len({g for x, g in rows if x == e and g in names}), sum(x == e and g in names for x, g in rows)) for e in {x for x, g in rows if g in names}}


def test_codes_and_strings_mix(spark):
    """Short sequences of known letters are numbers, others strings; both find the same pairs."""
    draw = random.Random(9)
    seqs = sorted({"".join(draw.choice("ACGU" if draw.random() < 0.97 else "N") for _ in range(draw.choice((5, 14)))) for _ in range(200)} | {"A", "C", "AC"})
    near = {s: "".join(draw.choice("ACGU") if draw.random() < 0.1 else c for c in s) for s in seqs}
    seqs = sorted({*seqs, *near.values()})
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    distance = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99
    for d in (1, 2):
        got = sorted((r.seq_a, r.seq_b, r.distance) for r in P.hamming_pairs(df, "seq", d).collect())
        assert got == sorted((a, b, distance(a, b)) for a, b in itertools.combinations(seqs, 2) if distance(a, b) <= d and (len(a) >= d or distance(a, b) < 99))
    snv = sorted((r.key_a, r.key_b, r.position, r.base_a, r.base_b) for r in P.snv_pairs(df.withColumn("key", F.col("seq")), "key", "seq").collect())
    want = [(a, b, next(i for i in range(len(a)) if a[i] != b[i])) for a in seqs for b in seqs if distance(a, b) == 1]
    assert snv == sorted((a, b, i, a[i], b[i]) for a, b, i in want)


def exact_neighbours(rows, k):
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    out = {}
    for i, scores in zip(ids, np.round(u @ u.T, 6), strict=True):
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), scores[j]) for j in order]
    return out


def near(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.neighbour, r.similarity))
        assert r["rank"] == len(out[r.query])
    return out


def test_neighbours_of_all_rows_against_all_pairs(spark):
    """The registered query: every row has its five neighbours, and at least nine of ten are those of all pairs."""
    from editlake.plans import all_queries

    folder = "/root/testdata/sf0.01"
    got = near(all_queries()[0]["knn_cosine_all"](spark, folder))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = exact_neighbours(rows, 5)
    assert set(got) == set(want) and all(len(n) == 5 for n in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in n}) for q, n in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_with_neighbourhoods_need_few_lists(spark):
    """Clustered vectors, a third of the rows one vector, and a null length: nearly exact, and copies are neighbours by id."""
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(20, 16))
    rows = [(i, (middle[0] if i % 3 == 0 else middle[i % 20] + draw.normal(scale=0.1, size=16)).tolist()) for i in range(900)]
    got, want = near(C.knn_cosine_all(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 4)), exact_neighbours(rows, 4)
    assert [got[0], got[3], got[897]] == [want[0], want[3], want[897]]
    assert sum(got[q] == n for q, n in want.items()) >= 0.95 * len(want)
    assert C.knn_cosine_all(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0
    assert near(C.knn_cosine_all(spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>"), "id", "v")) == {1: [(2, 0.0)], 2: [(1, 0.0)]}
