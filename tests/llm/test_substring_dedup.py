import random

import pytest
from brute import substring

from editlake.llm.queries import op3_substring_dedup
from editlake.llm.substring_dedup import _repeats, _repeats_by_string, substring_dedup

SCHEMA = "doc_id long, text string, id string, group string"


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df.repartition(3), **options).collect()]


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = substring([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op3_substring_dedup(spark, data).collect()}
    assert got == want and any(x[1] for x in want.values())


@pytest.mark.parametrize("window", [3, 5, 20])
def test_random_texts_with_few_words(spark, window):
    draw = random.Random(window)
    rows = [(i, draw.choice([" ", "\n", " \t"]).join(draw.choice("abc") for _ in range(draw.randint(0, 60)))) for i in range(60)]
    got = run(spark, rows, window=window)
    assert {d: (n, m) for d, n, m, _ in got} == {d: x[:2] for d, x in substring(rows, window).items()}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (1, long), (1, long), (2, None), (3, ""), (4, " \n "), (5, "one two"), (6, long + " tail"), (7, " ".join(["é☃"] * 5000))]
    got = sorted(run(spark, rows), key=str)
    assert len(got) == len(rows)
    assert [x[2] for x in got if x[0] is None] == [0]
    assert [x[2] for x in got if x[0] == 1] == [30, 30]
    assert [x for x in got if x[0] in (2, 3, 4)] == [(2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 0, "")]
    assert [x[3] for x in got if x[0] == 6] == ["tail"]
    assert [x[1:3] for x in got if x[0] == 7] == [(5000, 4999)]
    repeated = sorted(x[2] for x in run(spark, [(1, long), (1, long), (1, long)]))
    assert repeated == [0, 30, 30]


@pytest.mark.parametrize("window", [3, 20])
def test_long_minimisers(spark, monkeypatch, window):
    """Where all texts are large minimisers have more words; results stay the same."""
    import editlake.llm.substring_dedup as module

    monkeypatch.setattr(module, "LARGE", 0)
    draw = random.Random(window)
    rows = [(i, " ".join(draw.choice("abcd") for _ in range(draw.randint(0, 90)))) for i in range(50)] + [(90 + i, " ".join("ab" * 40)) for i in range(3)]
    got = run(spark, rows, window=window)
    assert {d: (n, m) for d, n, m, _ in got} == {d: x[:2] for d, x in substring(rows, window).items()}


def test_rows_of_one_id_are_told_apart(spark):
    texts = [" ".join(f"{c}{i}" for i in range(25)) for c in "abcdefgh"]
    rows = [(d, t) for d in (None, 4) for t in texts]
    got = run(spark, rows)
    assert sorted((d is None, m) for d, _, m, _ in got) == [(False, 25)] * 8 + [(True, 0)] * 8


def test_no_rows(spark):
    assert run(spark, []) == []


def test_hash_clash_falls_back_to_strings():
    rows = [(1, 0, 0, b"a b c d "), (2, 0, 5, b"b c d e "), (3, 0, 0, b"a b c ")]
    assert sorted(_repeats(rows, 3)) == sorted(_repeats_by_string(rows, 3)) == [(2, 0, 5, 8), (3, 0, 0, 3)]
