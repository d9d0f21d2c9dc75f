"""Stages of the pipeline judge rows, not ids: documents without an id or with the same one stand for themselves."""

import random

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=60):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOC)


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())


def marked(rows):
    return sorted((d is None, d or 0, t) for d, t in rows)


def test_near_dedup(spark, data):
    a, b, c, d, e = map(text, range(5))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, d), (None, c), (7, e), (7, e)]
    got = kept(corpus_pipeline.simhash_near_dedup(spark, frame(spark, rows), data))
    assert got == marked([(None, a), (None, b), (5, c), (3, d), (7, e)])


def test_decontamination(spark, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("text is not null").first().text
    bad = f"{text(1, 9)} {item} {text(2, 9)}"
    rows = [(None, text(3)), (None, bad), (4, text(5)), (4, bad)]
    got = kept(corpus_pipeline.benchmark_decontamination(spark, frame(spark, rows), data))
    assert got == marked([(None, text(3)), (4, text(5))])


def test_classifier(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    known = docs.join(labels, "doc_id").select("text", "quality").distinct().collect()
    good, bad = ([r.text for r in known if r.quality == q and r.text] for q in (1, 0))
    added = [(None, t) for t in good[:20]] + [(None, t) for t in bad[:20]]
    got = corpus_pipeline.quality_classifier(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(frame(spark, added)), str(tmp_path))
    left = [r.text for r in got.where("doc_id is null").collect()]
    assert sum(t in left for t in good[:20]) >= 18 and sum(t in left for t in bad[:20]) <= 2
