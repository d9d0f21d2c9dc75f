"""Registered queries read the whole of their tables, against plain loops."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from editlake.functions import metrics as M
from editlake.operators import pairs as P
from editlake.plans import all_queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, _ = all_queries()


def core_pairs(spark, least):
    cores = defaultdict(set)
    parts = spark.read.parquet(f"{SMALL}/part.parquet").collect()
    for r in parts:
        cores[r.p_brand].add(r.p_partkey)
        cores[f"{r.p_brand}_{r.p_type}"].add(r.p_partkey)
    mass = {r.p_partkey: r.p_retailprice for r in parts}
    return sorted((c, a, b) for c, m in cores.items() if len(m) >= least for a, b in itertools.combinations(sorted(m), 2) if abs(mass[a] - mass[b]) <= 200)


def test_pairs_have_the_stated_band(spark):
    got = sorted(tuple(r) for r in QUERIES["mmp_pairs_by_core"](spark, SMALL).select("core", "mol_a", "mol_b").collect())
    assert got == core_pairs(spark, 5)


def test_parts_of_a_large_core_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(P, "CORE_PART", 4)
    got = sorted(tuple(r) for r in QUERIES["mmp_pairs_by_core"](spark, SMALL).select("core", "mol_a", "mol_b").collect())
    assert got == core_pairs(spark, 5)


def tau(rows):
    sign = lambda a, b: (a > b) - (a < b)
    two = [(sign(a[0], b[0]), sign(a[1], b[1])) for a, b in itertools.combinations(rows, 2)]
    scale = (sum(x != 0 for x, _ in two) * sum(x != 0 for _, x in two)) ** 0.5
    return sum(a * b for a, b in two) / scale if scale else None


@pytest.mark.parametrize("bucket", [4, 1 << 14])
def test_kendall_of_all_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket, raising=False)
    draw = random.Random(3)
    groups = {"large": [(draw.randint(0, 40), draw.randint(0, 90) / 4) for _ in range(400)], "binary": [(i % 2, draw.random()) for i in range(60)], None: [(1, 2), (2, 1), (3, 3)], "same": [(1, 2), (1, 3)], "one": [(1, 1)]}
    df = spark.createDataFrame([(g, float(a), float(b)) for g, rows in groups.items() for a, b in rows] + [("large", None, 1.0)], "g string, y_true double, y_pred double")
    got = {r.g: (r.n, r.kendall) for r in M.kendall_tau(df, ["g"]).collect()}
    assert got == {g: (len(rows), None if (t := tau(rows)) is None else pytest.approx(t, abs=1e-6)) for g, rows in groups.items()}


def test_kendall_has_every_supplier(spark):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{MIDDLE}/lineitem.parquet").collect():
        lines[r.l_suppkey].append((r.l_quantity, r.l_quantity * (1 - r.l_discount) + 10 * r.l_tax))
    got = {r.l_suppkey: r for r in QUERIES["kendall_tau"](spark, MIDDLE).collect()}
    assert {s: r.n for s, r in got.items()} == {s: len(rows) for s, rows in lines.items()}
    for s in (max(lines), min(lines)):
        assert got[s].kendall == pytest.approx(tau(lines[s]), abs=2e-6)


def test_no_id_ranges(spark, tmp_path):
    line = spark.read.parquet(f"{MIDDLE}/lineitem.parquet").withColumn("l_suppkey", F.col("l_suppkey") + 1000).withColumn("l_orderkey", F.col("l_orderkey") + 1000)
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{MIDDLE}/part.parquet").write.parquet(str(tmp_path / "part.parquet"))
    rows = line.collect()
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert len(run("unpivot_cell_lines")) == sum(bool(r[c]) for r in rows for c in ("l_tax", "l_discount"))
    assert [r.mol_id for r in run("molecules_distinct_join")] == sorted({r.l_partkey for r in rows})[:500]
    prices = defaultdict(list)
    for r in rows:
        if r.l_returnflag == "A":
            prices[r.l_suppkey].append(r.l_extendedprice)
    want = sorted(0.001987 * 298 * math.log(r.l_extendedprice / (sum(p) / len(p) if (p := prices.get(r.l_suppkey)) else 100)) for r in rows if r.l_returnflag != "A")
    assert sorted(r.ddg for r in run("reference_kd_ddg")) == pytest.approx(want, abs=2e-6)
