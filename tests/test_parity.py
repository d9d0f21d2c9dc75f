"""Every query that SQL can state equals its SQL, as an unordered set of rows, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from editlake.plans import all_queries
from editlake.plans.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()
NO_SQL = {"butina_clusters", "kmer_leader_clusters", "kmer_leader_clusters_by_length", "kmeans_edit_clusters", "knn_cosine_all", "correlation_tests", "ridge_delta_model", "ridge_edit_model", "pca_projection", "split_by_cluster", "split_by_sequence_similarity", "split_pairs_by_cluster_priority"}


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(float(v) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(plain(v[k]) for k in v) + "}"
    return str(v)[:19] if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in (x.asDict(recursive=True) for x in df.collect()))
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted("|".join(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_queries_without_sql_are_the_known_ones():
    assert set(QUERIES) - set(SQL) == NO_SQL
