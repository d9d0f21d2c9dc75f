"""Values worked out by hand, readers, restarts and repeated rows."""

import decimal
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from editlake.functions import metrics as M
from editlake.functions import sequence as Q
from editlake.functions import tables as T
from editlake.operators import models as L
from editlake.operators import pairs as P
from editlake.operators import splits as S
from editlake.operators.aggregates import frequency
from editlake.operators.ordering import running_total
from editlake.plans import all_queries
from editlake.sources import tables as IO
from editlake.streaming.incremental import incremental_totals

SMALL = "/root/testdata/sf0.001"


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)).select(column().alias("v")).first().v


def test_kozak_by_hand(spark):
    f = lambda s: value(spark, lambda: Q.kozak_score(F.col("s")), s=s)
    assert f("GCCACCAUGAG") == pytest.approx((0.5 + 0.5 + 0.5 + 0.5 + 0.4 + 0.4 + 0.5) / 3.3)  # 4 counts from the A
    assert f("UUUAUG") == pytest.approx((0.05 + 0.2 + 0.2) / 3.3)
    assert f("CCC") == 0


def test_motifs_by_hand(spark):
    f = lambda s: value(spark, lambda: Q.motif_flags(F.col("s")), s=s)
    assert f("AUUAUGCCCC").kozak and not f("AUUAUGCCC").kozak and f("ACCAUGG").kozak and not f("UUUAUGCCCC").kozak
    assert f("GGGCCCAAAA").gc_rich and not f("GGGCCAAAAA").gc_rich and not f("").gc_rich
    ares = {(m.kind, m.position) for m in value(spark, lambda: Q.find_are_motifs(F.col("s")), s="GAUUUAUUUAGUUUUUU")}
    assert ares == {("class_I", 1), ("class_II", 1), ("class_III", 11)}


def test_edit_vectors_by_hand(spark):
    f = lambda a, b: value(spark, lambda: Q.edit_vector(F.col("a"), F.col("b")), a=a, b=b)
    assert f("ACGU", "ACAU") == pytest.approx([1, 0, 0, 0, 2 / 4, math.log(2) / 5, 0, 0, -0.25])
    assert f("AUG", "AUGG")[:6] == pytest.approx([0, 1, 0, 0, 3 / 4, math.log(2) / 5])
    assert f("AUGAUG", "AUG")[7] == -1 and f("AAA", "AAA")[:4] == [0, 0, 0, 1]
    g = lambda a, b: value(spark, lambda: Q.edit_signature(F.col("a"), F.col("b")), a=a, b=b)
    assert [g("ACGUAC", "GCGUAC"), g("ACGUAC", "ACGUAA"), g("ACGUAC", "ACUUAA"), g("A", "AC"), g("AC", "A"), g("A", "A")] == ["snv|0|transition", "snv|2|transversion", "multiple_snv|1|transversion", "insertion|0|indel", "deletion|0|indel", "identical|0|none"]
    h = spark.createDataFrame([(2, "A", "M", "A_vs_A"), (9, "U", "G", "M_vs_A"), (0, "A", "A", None)], "p int, a string, b string, k string")
    got = [r.v for r in h.select(Q.edit_onehot(F.col("p"), F.col("a"), F.col("b"), F.col("k")).alias("v")).collect()]
    assert [[i for i, x in enumerate(v) if x] for v in got] == [[2, 10, 21], [6, 19, 23], [0]] and {len(v) for v in got} == {24}


def test_residues(spark):
    scores = T.blosum62()
    assert len(scores) == 400 and all(scores[x + y] == scores[y + x] for x in T.ORDER for y in T.ORDER)
    assert [scores[k] for k in ("WW", "CC", "AR", "IL", "WD", "HY", "VI", "XX"[:1] + "X") if k in scores] == [11, 9, -1, 2, -4, 2, 3]
    assert set(T.RESIDUES) == set(T.ORDER)
    f = lambda a, b, scaled: spark.createDataFrame([(a, b)], "a string, b string").select(*(v.alias(k) for k, v in T.mutation_properties(F.col("a"), F.col("b"), scaled).items())).first()
    assert tuple(f("K", "D", False)) == pytest.approx((-1, 0.4, -2, 111.1 - 168.6, 115.03 - 128.09))
    assert tuple(f("K", "D", True)) == pytest.approx((-1 / 11, 0.4 / 9, -1, (111.1 - 168.6) / 170, (115.03 - 128.09) / 130))
    assert f("a", "?", False).blosum == 0 and f("A", "?", False).d_volume == pytest.approx(-88.6)


def test_edit_names(spark):
    f = lambda e: (value(spark, lambda: T.edit_name(F.col("e")), e=e), value(spark, lambda: T.edit_category(F.col("e")), e=e))
    assert [f(e) for e in ("[H]>>C", "F>>[H]", "[H]>>F", "N>>C", "C>>Q")] == [("methylation", "alkylation"), ("defluorination", "dehalogenation"), ("fluorination", "halogenation"), ("deaza_substitution", "heteroatom_substitution"), ("C>>Q", "other")]


def test_site_features(spark):
    s = "ACGUUACGGAUAUAC"
    row = spark.createDataFrame([(s, 7)], "s string, c int").select(*(v.alias(k) for k, v in Q.site_features(F.col("s"), F.col("c"), (2, 50)).items())).first()
    assert row.global_gc == round(6 / 15, 6) and row.gc_2 == round(sum(c in "GC" for c in s[5:10]) / 5, 6) and row.gc_50 == row.global_gc
    assert (row.left_c, row.right_g, row.left_a) == (1, 1, 0)
    for pair in ("UA", "AU", "AC", "UU"):
        assert row[f"pair_{pair.lower()}"] == round(sum(s[i : i + 2] == pair for i in range(14)) / 14, 6)


def test_ranks_of_repeated_rows(spark):
    """Rows that repeat a key, with other values or wholly, have places of their own."""
    rows = [("g", 1, 5.0, 2.0), ("g", 1, 5.0, 3.0), ("g", 1, 4.0, 3.0), ("g", 2, 4.0, 3.0), ("g", 2, 4.0, 3.0), ("h", 1, 1.0, 1.0)]
    got = M.top_ranks(spark.createDataFrame(rows, "t string, k int, y double, p double"), ["t"], "y", "p", ["k"]).collect()
    assert sorted((r.t, r.k, r.y, r.p) for r in got) == sorted(rows)
    for t, n in (("g", 5), ("h", 1)):
        for name in ("__ty", "__tp"):
            assert sorted(r[name] for r in got if r.t == t) == list(range(1, n + 1))
    assert {(r.y, r.p): r["__ty"] for r in got if r.t == "g" and r.k == 1} == {(5.0, 2.0): 1, (5.0, 3.0): 2, (4.0, 3.0): 3}


def test_weights_and_p_values(spark):
    rows = [("a", 1.0, 1.5, 1.0), ("a", 2.0, 1.0, 3.0), ("a", 4.0, 5.0, 2.0), ("a", None, 5.0, 2.0)]
    got = M.regression_metrics(spark.createDataFrame(rows, "g string, y_true double, y_pred double, w double"), ["g"], weight="w").first()
    y, p, w = (np.array([r[i] for r in rows[:3]]) for i in (1, 2, 3))
    mean = (w * y).sum() / w.sum()
    assert got.mse == pytest.approx((w * (p - y) ** 2).sum() / w.sum(), abs=1e-6) and got.mae == pytest.approx((w * abs(p - y)).sum() / w.sum(), abs=1e-6)
    assert got.r2 == pytest.approx(1 - (w * (p - y) ** 2).sum() / (w * (y - mean) ** 2).sum(), abs=1e-6)
    df = spark.createDataFrame([(0.5, 0.3, 20), (None, 1.0, 20), (1.0, 0.0, 2)], "pearson double, kendall double, n long")
    found = M.with_p_values(df, {"pearson": "pearson", "kendall": "kendall"}).collect()
    assert found[0].pearson_p == pytest.approx(0.0248, abs=1e-4) and found[0].kendall_p == pytest.approx(math.erfc(0.3 * 3 * math.sqrt(20 * 19 / (2 * 45)) / math.sqrt(2)))
    assert found[1].pearson_p is None and found[1].kendall_p < 1e-8 and found[2].pearson_p is None


def test_json_forms(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1, "b": {"c": "x"}}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "array.json").write_text('[{"a": 1, "b": {"c": "x"}},\n {"a": 2},\n {"a": 3}]')
    (tmp_path / "map.json").write_text(json.dumps({"p": {"a": 1}, "q": {"a": 2, "b": {"c": "y"}}}, indent=1))
    schema = "a int, b struct<c: string>"
    for name, lines in (("lines", True), ("array", False)):
        got = IO.read_json_records(spark, str(tmp_path / f"{name}.json"), schema, lines).collect()
        assert sorted(r.a for r in got) == [1, 2, 3] and {r.a: r.b and r.b.c for r in got}[1] == "x"
    assert {r.id: r.record.a for r in IO.read_json_map(spark, str(tmp_path / "map.json"), "a int").collect()} == {"p": 1, "q": 2}
    nested = spark.createDataFrame([(1, ("C",), (2.0,)), (2, (None,), (2.0,)), (3, None, (2.0,)), (4, ("C",), None)], "id int, s struct<smiles: string>, p struct<mw: double>")
    assert [tuple(r) for r in IO.flatten_records(nested, {"id": "id", "smiles": "s.smiles", "mw": "p.mw"}, ["s.smiles", "p"]).collect()] == [(1, "C", 2.0)]


def test_large_json_files_are_split(spark, tmp_path):
    """Braces, quotes and backslashes inside strings are no structure; one file is read by many tasks."""
    odd = ["}", "{", "[", '"', "\\", '\\"', '}\\"{', "\\\\", "a,b]", "", "é}", "line\n}"]
    records = [{"a": i, "b": {"c": odd[i % len(odd)] * (i % 4), "d": [{"e": i}] * (i % 3)}} for i in range(3000)]
    (tmp_path / "arrays").mkdir(), (tmp_path / "maps").mkdir()
    (tmp_path / "arrays" / "one.json").write_text(json.dumps(records, ensure_ascii=False))
    (tmp_path / "arrays" / "two.json").write_text("\n" + json.dumps(records[:5], indent=2) + "\n")
    (tmp_path / "arrays" / "three.json").write_text("[]")
    (tmp_path / "maps" / "one.json").write_text(json.dumps({f"k{i}}}": r for i, r in enumerate(records)}))
    (tmp_path / "maps" / "two.json").write_text(json.dumps({"x": records[7]}, indent=1) + "\n")
    schema = "a int, b struct<c: string, d: array<struct<e: int>>>"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        texts = IO.json_texts(spark, str(tmp_path / "arrays" / "one.json"), maps=False)
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "arrays" / "one.json")).rdd.getNumPartitions() > 4 and texts.count() == 3000
        plain = lambda r: {"a": r.a, "b": {"c": r.b.c, "d": [{"e": x.e} for x in r.b.d]}}
        key = lambda r: json.dumps(r, sort_keys=True)
        got = IO.read_json_records(spark, str(tmp_path / "arrays"), schema).collect()
        assert sorted(map(key, map(plain, got))) == sorted(map(key, records + records[:5]))
        got = IO.read_json_map(spark, str(tmp_path / "maps"), schema).collect()
        assert sorted((r.id, key(plain(r.record))) for r in got) == sorted([(f"k{i}}}", key(r)) for i, r in enumerate(records)] + [("x", key(records[7]))])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "single.json").write_text('{"a": 1, "b": {"c": "}"}}')
    assert [(r.a, r.b.c) for r in IO.read_json_records(spark, str(tmp_path / "single.json"), schema).collect()] == [(1, "}")]
    (tmp_path / "deep.json").write_text('{"k": {"a": 1, "b": {"y": 2}, "p": 1.25}}')
    assert [tuple(r.record) for r in IO.read_json_map(spark, str(tmp_path / "deep.json"), "a int, b struct<x: int, y: int>, p decimal(10,2)").collect()] == [(1, (None, 2), decimal.Decimal("1.25"))]


def test_a_database_is_read_in_ranges(spark):
    """Tables in an embedded database: ranges of a key, and filters that the database applies."""
    url = IO.embedded_database(spark, "ranges")
    rows = spark.range(1000).selectExpr("id activity_id", "id % 7 target", "concat('n', id) name", "id / 8 value")
    IO.write_relational(rows, url, "activities", {"name": "varchar(40)"})
    got = IO.read_relational(spark, url, "activities", key="activity_id", bounds=(0, 1000), partitions=5, fetchsize="50")
    assert got.rdd.getNumPartitions() == 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sorted(r["count"] for r in sizes) == [200] * 5
    asked = got.where("target = 3 and activity_id > 500").select("name")
    text = asked._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(target,3)" in text and "*GreaterThan(activity_id,500)" in text and "ReadSchema: struct<name:string>" in text
    assert sorted(r.name for r in asked.collect()) == sorted(f"n{i}" for i in range(501, 1000) if i % 7 == 3)
    assert IO.read_relational(spark, url, "activities").rdd.getNumPartitions() == 1


def test_long_intervals_have_few_bins(spark):
    from editlake.operators.joins import interval_bins, points_in_intervals

    draw = random.Random(5)
    spans = [(c, lo := draw.randrange(-5000, 10**7), lo + draw.choice((0, 1, 999, 1000, 8001, 10**5, 2 * 10**6, 9 * 10**8)), i) for i, c in enumerate(draw.choices("xyz", k=300))] + [("x", 5, 3, 999)]
    intervals = spark.createDataFrame(spans, "chrom string, lo long, hi long, i int")
    assert interval_bins(intervals, "lo", "hi").groupBy("i").count().agg(F.max("count")).first()[0] <= 2
    points = [(k, draw.choice("xyz"), draw.choice([draw.randrange(-5000, 10**7), draw.choice(spans)[draw.choice((1, 2))]])) for k in range(400)]
    df = spark.createDataFrame(points + points[:3], "k int, chrom string, pos long")
    want = sorted((k, i) for k, c, p in points + points[:3] for d, lo, hi, i in spans if c == d and lo <= p <= hi)
    got = points_in_intervals(df, intervals)
    assert sorted((r.k, r.i) for r in got.collect()) == want and got.columns == ["k", "chrom", "pos", "lo", "hi", "i"]
    held = {k for k, _ in want}
    assert sorted(r.k for r in points_in_intervals(df, intervals, how="left_semi").collect()) == sorted(k for k, _, _ in points + points[:3] if k in held)
    assert sorted(r.k for r in points_in_intervals(df, intervals, how="left_anti").collect()) == sorted(k for k, _, _ in points + points[:3] if k not in held)
    assert points_in_intervals(df, intervals.limit(0)).count() == 0


def test_totals_go_on_where_they_ended(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: {r.k: (r.v, r.n) for r in incremental_totals(spark, str(tmp_path / "in"), "k string, v long", ["k"], ["v"], str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    (tmp_path / "in").mkdir()
    assert run() == {}
    put([("a", 1), ("b", 2)])
    put([("a", 5)])
    assert run() == {"a": (6, 2), "b": (2, 1)} == run()
    put([("c", 1)])
    assert run() == {"a": (6, 2), "b": (2, 1), "c": (1, 1)}


def test_totals_write_changed_keys_and_merge(spark, tmp_path):
    """A batch writes as many rows as it changes keys; after three batches one table replaces their folders."""
    out = tmp_path / "out"
    put = lambda rows: spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: {r.k: (r.v, r.n) for r in incremental_totals(spark, str(tmp_path / "in"), "k string, v long", ["k"], ["v"], str(out), str(tmp_path / "state"), compact=3).collect()}
    want = {f"k{i}": (i, 1) for i in range(500)}
    put([(k, v) for k, (v, _) in want.items()])
    assert run() == want and sorted(p.name for p in out.iterdir()) == ["changed=0"]
    for number in (1, 2, 3):
        put([("k7", 1), (f"new{number}", 5)])
        want |= {"k7": (want["k7"][0] + 1, want["k7"][1] + 1), f"new{number}": (5, 1)}
        assert run() == want == run()
        names = sorted(p.name for p in out.iterdir())
        assert names == {1: ["changed=0", "changed=1"], 2: ["upto=2"], 3: ["changed=3", "upto=2"]}[number]
        if number != 2:
            assert spark.read.parquet(str(out / f"changed={number}")).count() == 2
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_batch_of_fragments_reads_its_own_buckets(spark, tmp_path):
    """Files of buckets that a batch does not touch may even be broken."""
    from editlake.streaming.incremental import incremental_pairs

    source, out = str(tmp_path / "in"), tmp_path / "out"
    put = lambda rows: spark.createDataFrame(rows, "mol_id long, core string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: sorted(tuple(r) for r in incremental_pairs(spark, source, "mol_id long, core string", str(out), str(tmp_path / "state"), buckets=8).collect())
    put([(i, f"c{i % 20}") for i in range(60)])
    want = sorted((f"c{a % 20}", a, b) for a in range(60) for b in range(a + 1, 60) if a % 20 == b % 20)
    assert run() == want
    touched = spark.sql("select pmod(xxhash64('c3'), 8) b").first().b
    for file in (out / "seen").rglob("*.parquet"):
        if f"bucket={touched}" not in str(file):
            file.write_bytes(b"broken")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    put([(100, "c3"), (101, "c3")])
    assert run() == sorted(want + [("c3", a, b) for a, b in itertools.combinations([3, 23, 43, 100, 101], 2) if b >= 100]) == run()


def test_genome_chunks_cross_lines(spark, tmp_path):
    draw = random.Random(2)
    want = {}
    for k in range(3):
        text = ""
        for i in range(4):
            seq = "".join(draw.choice("acgtN") for _ in range(draw.choice([0, 7, 40, 333])))
            name = f"c{k}_{i}"
            want |= {(name, j): seq[j * 50 : j * 50 + 50].upper() for j in range(-(-len(seq) // 50))}
            lines = [seq[j : j + 13] for j in range(0, len(seq), 13)]
            text += f">{name} some words\n" + "\n".join(lines) + "\n"
        (tmp_path / f"{k}.fa").write_text(text)
    got = {(r.chrom, r.chunk_no): r.chunk for r in IO.read_genome_chunks(spark, str(tmp_path), 50).collect()}
    assert got == want


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("short", [0, 12])
def test_hamming_pairs(spark, monkeypatch, distance, short):
    monkeypatch.setattr(P, "SHORT", short)
    draw = random.Random(7)
    seqs = sorted({"".join(draw.choice("AC") for _ in range(draw.choice([2, 6, 7]))) for _ in range(80)})
    got = {(r.s_a, r.s_b): r.distance for r in P.hamming_pairs(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", distance).collect()}
    far = {(a, b): sum(x != y for x, y in zip(a, b, strict=True)) for a in seqs for b in seqs if a < b and len(a) == len(b)}
    assert got == {k: d for k, d in far.items() if 1 <= d <= distance}


def test_listed_and_rare_splits(spark):
    df = spark.createDataFrame([(i, "abcdefghij"[min(9, int((i % 100) ** 0.5))]) for i in range(600)], "id long, v string")
    got = S.listed_split(df, "v", ["a", "b", "j"], ["c"], ["id"]).collect()
    assert {r.v for r in got} == {"a", "b", "c", "j"} and all((r.split == "test") == (r.v == "c") for r in got)
    n = sum(r.v != "c" for r in got)
    assert sum(r.split == "val" for r in got) == n * 15 // 85
    held = {r.v for r in S.rare_holdout_split(df, "v", ["id"]).collect() if r.split == "test"}
    assert held == {"a", "b", "c"}


def test_totals_and_frequencies_span_partitions(spark):
    df = spark.createDataFrame([(i * 7 % 1000, i % 5) for i in range(1000)], "k int, v int").repartition(7)
    got = running_total(df, ["k"], "v", "before").orderBy("k").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.v
    counts = frequency(spark.createDataFrame([(x,) for x in "abbcccdddd"], "c string"), "c", 3).orderBy("rank").collect()
    assert [tuple(r) for r in counts] == [("d", 4, 40.0, 1), ("c", 3, 30.0, 2), ("b", 2, 20.0, 3)]


def test_ridge_on_edits(spark):
    rows = all_queries()[0]["ridge_edit_model"](spark, SMALL).collect()
    assert len(rows) > 1000 and all(math.isfinite(r.delta) for r in rows)
    draw = np.random.default_rng(3)
    x, w = draw.normal(size=(200, 9)), draw.normal(size=9)
    y = x @ w + 2
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    got = {r.id: r.f for r in L.predict(L.ridge(df, "x", "y"), df, "x", "f").collect()}
    xc = x - x.mean(axis=0)
    beta = np.linalg.solve(xc.T @ xc + np.eye(9), xc.T @ (y - y.mean()))
    assert np.allclose([got[i] for i in range(200)], xc @ beta + y.mean(), atol=1e-4)


def test_kmer_clusters_by_loop(spark):
    """Leaders of whole texts, longest first, against the sequence of steps."""
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGUACGUACGUACGUACGUACGUAC").alias("s")).collect() if r.s]
    first = {}
    for r in sorted(rows):
        first.setdefault(r.s, r.doc_id)
    kmers = {d: {s[i : i + 8] for i in range(len(s) - 7)} for s, d in first.items()}
    size = {d: len(s) for s, d in first.items()}
    for name, key, same in (("kmer_leader_clusters", lambda d: (-size[d], d), False), ("kmer_leader_clusters_by_length", lambda d: d, True)):
        left, want = sorted(kmers, key=key), {}
        while left:
            leader = left[0]
            for d in left:
                union = kmers[leader] | kmers[d]
                if d == leader or (union and len(kmers[leader] & kmers[d]) / len(union) >= 0.7 and (not same or size[d] == size[leader])):
                    want[d] = leader
            left = [d for d in left if d not in want]
        assert {r.id: r.leader for r in all_queries()[0][name](spark, SMALL).collect()} == want


def test_views_read_whole_texts(spark):
    from editlake.plans.fixtures import table

    letters = {r.text_id: r.letters for r in table(spark, SMALL, "letters").collect()}
    for view, column, n in (("seqs", "seq", 50), ("seq7", "loop", 7)):
        rows = table(spark, SMALL, view).select("doc_id", "text_id", column).collect()
        assert len({r.doc_id for r in rows}) == len(rows) and {len(r[column]) for r in rows} == {n}
        assert len(rows) == sum(-(-len(s) // n) for s in letters.values())
        one = max(letters, key=lambda k: len(letters[k]))
        pieces = [r[column] for r in sorted(rows) if r.text_id == one]
        assert letters[one].startswith("".join(pieces[:-1])) and letters[one].endswith(pieces[-1])
    assert table(spark, SMALL, "intervals").count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
