"""Results that were wrong or partial on larger or odd tables, against plain loops and SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from editlake.operators import clustering as C
from editlake.operators import joins as J
from editlake.operators import pairs as P
from editlake.plans import all_queries
from editlake.plans import pairs as plans
from editlake.plans import registry

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = all_queries()


@pytest.fixture
def spread(spark):
    """Shuffles keep their partitions, as those of large tables do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["knn_cosine", "knn_neighbour_delta"])
def test_parts_and_blocks_of_the_search_meet(spread, monkeypatch, name):
    monkeypatch.setattr(C, "PART", 60)
    monkeypatch.setattr(C, "BLOCK", 2)
    found = QUERIES[name](spread, SMALL)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SMALL}/embeddings.parquet')")
    want = con.execute(f"select {', '.join(found.columns)} from ({SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_differences_of_vectors_keep_the_sign_of_zero(spark, tmp_path):
    vectors = [(i, [x / 1e6, -x / 1e6, 0.1234565 * x]) for i, x in enumerate((3.0, 1.0, 4.0, 1.5))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = QUERIES["embedding_difference"](spark, str(tmp_path)).select("a", "b", "diff").collect()
    want = con.execute(f"select a, b, diff from ({SQL['embedding_difference']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and "-0.0" in repr(want)


def test_design_matrix_rounds_as_sql_and_keeps_texts_without_letters(spark, tmp_path):
    """Shares of 640 letters end in a half of the last digit, where decimal and binary rounding part."""
    texts = ["", "12 3", None, "ACGU", *("c" * k + "a" * (n - k) for n in (640, 1920, 3200) for k in range(0, n, 7))]
    rows = [(i, s, "en", "src1", len(s or "")) for i, s in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = QUERIES["design_matrix"](spark, str(tmp_path)).select("site_id", "features").collect()
    want = con.execute(f"select site_id, features from ({SQL['design_matrix']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def written(spark, run):
    """Rows that the shuffles of a run write."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    sc.setJobGroup("written", "written")
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("written") for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.mark.parametrize("name", ["pair_measurement_join_m2m", "pivot_tasks_first"])
def test_no_row_for_each_pair_is_shuffled(spark, name):
    rows, moved = written(spark, lambda: QUERIES[name](spark, MIDDLE).collect())
    assert len(rows) > 70_000 and moved < 230_000


@pytest.mark.parametrize("items", [5, 70, 600])
def test_sets_as_bits_lose_no_pair(spark, monkeypatch, items):
    monkeypatch.setattr(P, "BIT_BLOCK", 50)
    draw = random.Random(items)
    sets = [(i * 3, [draw.randrange(items) for _ in range(draw.choice((0, 1, 3, 12, 30)))]) for i in range(300)]
    sets += [(10_000 + k, v[:]) for k, v in sets[:40]]
    rows = spark.createDataFrame(sets, "k long, v array<int>")
    got = {(r.k_a, r.k_b): r.similarity for r in P.bit_similarity_join(rows, "k", "v", 0.4).collect()}
    pairs = ((a, b, len(set(x) & set(y)), len(set(x) | set(y))) for a, x in sets for b, y in sets if a < b)
    assert got == pytest.approx({(a, b): n / u for a, b, n, u in pairs if u and n >= 0.4 * u})


def test_few_items_make_no_candidates(spark):
    rows, moved = written(spark, lambda: QUERIES["tanimoto_join"](spark, MIDDLE).collect())
    assert len(rows) == 56 and moved < 2000


def count_rows_of(monkeypatch, module, name):
    """Counts what a function returns from now on."""
    made, f = [], getattr(module, name)

    def counted(*a, **b):
        out = f(*a, **b)
        made.append(out.count())
        return out

    monkeypatch.setattr(module, name, counted)
    return made


@pytest.mark.parametrize(("name", "most"), [("pairs_by_target", 10_000), ("pairs_by_entity", 2000), ("pairs_by_property", 5000), ("candidate_core_intersection", 1000)])
def test_only_pairs_that_can_be_asked_for_are_made(spark, monkeypatch, name, most):
    made = count_rows_of(monkeypatch, P, "mmp_pairs")
    assert QUERIES[name](spark, MIDDLE).count() > 0 and sum(made) <= most


@pytest.mark.parametrize("name", ["unambiguous_strand", "split_by_gene", "point_to_interval_map"])
def test_equal_intervals_and_places_are_matched_once(spark, monkeypatch, tmp_path, name):
    for table in ("documents", "labels", "orders"):
        rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
        rows = rows.unionByName(rows.withColumn("o_orderkey", F.col("o_orderkey") + 120_000)) if table == "orders" else rows
        rows.write.parquet(str(tmp_path / f"{table}.parquet"))
    made = count_rows_of(monkeypatch, J, "points_in_intervals")
    once, twice = QUERIES[name](spark, SMALL).count(), QUERIES[name](spark, str(tmp_path)).count()
    assert once == twice and made[0] == made[1]


def test_first_rows_go_on_until_there_are_enough(spark, monkeypatch):
    monkeypatch.setattr(plans, "FEW", 2)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{MIDDLE}/{t}.parquet')")
    got = QUERIES["pairs_by_property"](spark, MIDDLE).select("mol_a", "mol_b", "edit", "delta").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select mol_a, mol_b, edit, delta from ({SQL['pairs_by_property']})").fetchall())


@pytest.mark.parametrize("items", [4, 400])
def test_sets_that_agree_in_a_column_lose_no_pair(spark, items):
    """Many pairs of small sets go by shared items, few pairs of large ones are counted as they meet."""
    draw = random.Random(items)
    sets = [(i, draw.randrange(2 if items == 4 else 40), sorted({draw.randrange(items) for _ in range(draw.choice((1, 2, items // 2, items)))})) for i in range(200)]
    sets += [(1000 + k, n, v[:-1] or v) for k, n, v in sets[:100]]
    rows = spark.createDataFrame(sets, "k long, n int, v array<int>")
    got = {(r.k_a, r.k_b) for r in P.set_similarity_join(rows, "k", "v", 0.7, within="n").collect()}
    want = {(a, b) for a, m, x in sets for b, n, y in sets if a < b and m == n and len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y))}
    assert got == want


def test_only_sequences_of_one_length_meet(spark, monkeypatch):
    made = count_rows_of(monkeypatch, P, "set_tokens")
    QUERIES["kmer_leader_clusters_by_length"](spark, SMALL).collect()
    texts = [r.letters for r in registry.Tables(spark, SMALL)("letters").where("length(letters) > 0").select("letters").distinct().collect()]
    lengths = [len(s) for s in texts]
    assert sum(made) <= sum(lengths.count(n) > 1 for n in lengths) < len(texts)


def test_bins_are_counted_inside_the_row(spark):
    rows, moved = written(spark, lambda: QUERIES["positional_bins"](spark, SMALL).count())
    assert rows > 100_000 and moved < 2000


def test_entities_follow_classes_not_pairs(spark, monkeypatch, tmp_path):
    """Ten copies of each molecule make a hundred times the pairs, and as many pairs of classes; masses outside the band part them."""
    part = spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_retailprice", F.when(F.col("p_brand") < "Brand#2", F.col("p_retailprice")).otherwise(F.col("p_partkey") % 7 * 90.0))
    part.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("k")).drop("k").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made, f = [], P.with_edits
    monkeypatch.setattr(P, "with_edits", lambda pairs, *a: made.append(pairs.count()) or f(pairs, *a))
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = [r.entity for r in QUERIES["distinct_entities_union"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(r[0] for r in con.execute(SQL["distinct_entities_union"]).fetchall()) and sum(made) < 5000


def test_reference_distance_of_short_and_long_sequences(spark):
    draw = random.Random(5)
    rows = [(g, i, float(i), "".join(draw.choice("ACGU") if draw.random() < 0.1 else c for c in base)) for g, base in enumerate(("ACGUACG", "ACGUACGUACGU", "ACGUACGUACGUA" * 3)) for i in range(60)]
    rows.append((0, 99, -1.0, "ACG"))
    got = {(r.g, r.k): r.n_changes for r in P.reference_pairs(spark.createDataFrame(rows, "g int, k int, v double, s string"), ["g"], "v", "k", "s").collect()}
    best = {g: s for g, k, _, s in rows if k == 59}
    apart = {(g, k): sum(x != y for x, y in zip(s, best[g], strict=True)) for g, k, _, s in rows if k != 59 and len(s) == len(best[g])}
    assert got == {k: n for k, n in apart.items() if 1 <= n <= 5}
