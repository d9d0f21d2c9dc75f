from collections import Counter, defaultdict

from brute import leaks, simhash_components, words
from pyspark.sql import functions as F

import corpus_pipeline
from editlake.llm.mixing import SLOPES, curriculum_mix, mixed_documents
from editlake.llm.sharding import interleaved_shards


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], data).write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(h.dtypes == docs.dtypes for h in held[1:5])
    rows = [{r.doc_id: r.text for r in h.select("doc_id", "text").collect()} for h in held[:5]]
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in rows[1] for d in good) >= 0.98 * len(good)
    assert sum(d in rows[1] for d, q in labels.items() if q == 0) <= 0.1 * (len(labels) - len(good))
    assert set(rows[2]) == {c for _, c in simhash_components(list(rows[1].items())).values()}
    assert set(rows[3]) == set(rows[2]) - {d for d, _ in leaks(rows[2].items(), items)}
    uses = Counter(r.doc_id for r in held[4].select("doc_id").collect())
    total = sum(len(words(t)) for t in rows[3].values())
    assert set(uses) <= set(rows[3]) and max(uses.values()) <= 2
    assert abs(sum(n * len(words(rows[3][d])) for d, n in uses.items()) - 1.5 * total) < 0.1 * total
    last = held[5].groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in last) == sum(uses.values()) and len(last) == 40 and max(r.n for r in last) - min(r.n for r in last) <= 1
    inside, sources = defaultdict(list), {r.doc_id: r.source for r in held[4].select("doc_id", "source").collect()}
    for r in held[5].collect():
        inside[r.shard].append((r.slot, r.position, r.doc_id))
    for rows_of in inside.values():
        rows_of.sort()
        assert [s for s, _, _ in rows_of] == list(range(len(rows_of))) and [p for _, p, _ in rows_of] == sorted(p for _, p, _ in rows_of)
    places = {s: i for i, s in enumerate(sorted(set(sources.values()), key=str.encode))}
    late = {k: [p for rows_of in inside.values() for _, p, d in rows_of if places[sources[d]] % 3 == k] for k in range(3)}
    mean = {k: sum(v) / len(v) for k, v in late.items()}
    assert mean[0] > 0.54 > mean[1] > 0.46 > mean[2]  # slopes 0.5, 0 and -0.5: a mean of 1/2 and a sixth of the slope


def test_positions_are_those_of_the_mix(spark, data):
    """Uses that the mixing stage writes get the positions that the mix gave them, as near as whole uses can: one in part counts with all its words, which moves the rest of a small source."""
    docs = spark.read.parquet(f"{data}/documents.parquet").dropDuplicates(["text"])
    mix = curriculum_mix(docs)
    given = {(r.doc_id, i): u.position for r in mix.select("doc_id", "uses").collect() for i, u in enumerate(r.uses)}
    got = defaultdict(list)
    for r in interleaved_shards(mixed_documents(docs, mix), slopes=SLOPES).collect():
        got[r.doc_id].append(r.position)
    pairs = [(p, given[d, i]) for d, some in got.items() for i, p in enumerate(sorted(some))]
    apart = sorted(abs(a - b) for a, b in pairs)
    assert len(apart) > 500 and apart[len(apart) * 9 // 10] < 0.02 and apart[-1] < 0.2


def test_no_documents(spark, data, tmp_path):
    import shutil

    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        shutil.copy(f"{data}/{t}.parquet", tmp_path / f"{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
