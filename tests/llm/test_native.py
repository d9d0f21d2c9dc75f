"""Exact and line dedup, chats, decontamination, sharding and mixing: odd rows and plain re-statements."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from brute import leaks, targets, words

from editlake.llm.chat import format_chats
from editlake.llm.decontaminate import contaminated, decontaminated
from editlake.llm.exact_dedup import exact_dedup, merged, run_tree
from editlake.llm.line_dedup import line_dedup, line_ids, repeated_runs, suffix_array, with_lcp
from editlake.llm.mixing import curriculum_mix, mixed_documents
from editlake.llm.queries import op8_benchmark_decontamination, op9_sharding, op10_source_mixing
from editlake.llm.sharding import interleaved_shards

SCHEMA = "doc_id long, text string, source string, size long, run int, id string, lines int, key string, taken int"
LONG = "\n".join(f"line {i} of a very long text" for i in range(20_000))
MANY = "\n".join(f"line {i}" for i in range(130))
ROWS = [(None, "a b"), (1, "ab"), (2, "a  b "), (2, "a  b "), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG), (8, "AB"), (9, "é b"), (10, "éb")]


def frame(spark, rows, source=lambda d: "s" if d else None):
    return spark.createDataFrame([(d, t, source(d), 7, 7, "x", 7, "x", 7) for d, t in rows], SCHEMA).repartition(3)


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is not None, d or 0))
    want = Counter()
    for text, members in groups.items():
        best = min(members)
        for m in members:
            want[(m[2] if m[1] else None, best[2] if best[1] else None, len(members), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(set(r.text_sha256 for r in got))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("runs", [1, 2, 3, 11])
def test_run_tree_merges_pairwise(spark, monkeypatch, runs):
    import editlake.llm.exact_dedup as module

    rounds = []
    monkeypatch.setattr(module, "merged", lambda level, tasks, bits: rounds.append(bits) or merged(level, tasks, bits))
    entries = [(r, hashlib.sha256(str(k).encode()).digest(), k, 5, (-k, 100 * r + k, 100 * r + k), r + 1) for r in range(runs) for k in range(r % 4, 40)]
    df = spark.createDataFrame(entries, "run long, digest binary, second long, n_normal int, best struct<shorter:int,id:long,row:long>, group_size long")
    got = {r.second: (r.best.id, r.group_size) for r in run_tree(df, runs).collect()}
    assert got == {k: (min(100 * r + k for r in range(runs) if k >= r % 4), sum(r + 1 for r in range(runs) if k >= r % 4)) for k in range(40) if any(k >= r % 4 for r in range(runs))}
    assert len(rounds) == (runs - 1).bit_length()


def test_exact_dedup_over_many_partitions(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot  text" + " " * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(df).collect()}
    groups = defaultdict(list)
    for d, t in rows:
        groups[t.replace(" ", "")].append((-len(t), d))
    assert got == {d: (min(g)[1], len(g)) for g in groups.values() for _, d in g}


def lines_left(rows, least=3, enough=20):
    """Later copies of runs of `least` lines, or of fewer with `enough` words, by a set of all runs seen."""
    seen, out = {}, {}
    for d, t in rows:
        ls = t.split("\n") if t else []
        gone = set()
        for i in range(len(ls)):
            for n in range(1, least + 1):
                run = tuple(ls[i : i + n])
                if len(run) == n and (n == least or len(words(" ".join(run))) >= enough) and seen.setdefault(run, (d, i)) != (d, i):
                    gone |= set(range(i, i + n))
        out[d] = (len(ls), len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


@pytest.mark.parametrize(("least", "enough"), [(1, 20), (3, 20), (6, 3), (3, 2)])
def test_line_dedup(spark, least, enough):
    rows = [(i, "\n".join("abc"[(i * j * j + j // 4) % 3] * (1 + j % 2) for j in range(i % 23))) for i in range(1, 30)] + [(90, MANY), (91, MANY + "\nend"), (92, None), (93, "")]
    rows += [(94, "x\n" + "long line " * 12 + "\nshort\ny"), (95, "z\n" + "long line " * 12 + "\nshort\nw"), (96, "long line " * 12)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(frame(spark, rows), least, enough).collect()}
    assert got == lines_left(rows, least, enough)


def test_suffix_array_and_lcp(spark):
    """Each suffix stands beside one that shares most lines with it, and lcp is what neighbours share."""
    rows = [(i, "\n".join("abc"[(i * j * j + j // 4) % 3] for j in range(i % 17))) for i in range(1, 30)] + [(90, "\n".join(f"l{i % 30}" for i in range(90))), (91, "\n".join(f"l{i % 30}" for i in range(70)))]
    got = with_lcp(suffix_array(line_ids(frame(spark, rows))[1])).select("id", "no", "lcp", "pos").orderBy("pos").collect()
    texts = {i: t.split("\n") for i, t in rows}
    suffix = [texts[r.id][r.no :] for r in got]

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    assert [r.pos for r in got] == list(range(len(got)))
    assert [r.lcp for r in got] == [0, *(shared(a, b) for a, b in itertools.pairwise(suffix))]
    beside = [max([shared(suffix[j], s) for j in (i - 1, i + 1) if 0 <= j < len(suffix)]) for i, s in enumerate(suffix)]
    assert beside[::7] == [max(shared(s, t) for j, t in enumerate(suffix) if j != i) for i, s in enumerate(suffix) if i % 7 == 0]
    assert max(r.lcp for r in got) >= 60


def test_long_copies_take_few_rounds(spark, monkeypatch):
    """Copies of 1,100 lines are ranked in three rounds: few frames are written down, whose plans the driver holds; lcp counts all lines."""
    import editlake.llm.line_dedup as module

    written, real = [], module.checkpointed

    def counted(df):
        written.append(df)
        assert len(written) <= 10
        return real(df)

    monkeypatch.setattr(module, "checkpointed", counted)
    a = [f"l{i % 7}" if i % 50 else f"m{i // 50 % 3}" for i in range(1_100)]
    b = [*a[:600], "only here", *a[601:]]
    rows = [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(["x", *a[40:], "y"])), (4, "\n".join(a))]
    got = with_lcp(suffix_array(line_ids(frame(spark, rows))[1])).select("id", "no", "lcp", "pos").orderBy("pos").collect()
    texts = {i: t.split("\n") for i, t in rows}
    assert [r.pos for r in got] == list(range(len(got))) and {(r.id, r.no) for r in got} == {(i, j) for i, t in texts.items() for j, x in enumerate(t) if x not in ("x", "y", "only here")}

    def shared(p, q):
        x, y = texts[p.id], texts[q.id]
        n = next((i for i in range(min(len(x) - p.no, len(y) - q.no)) if x[p.no + i] != y[q.no + i]), None)
        return min(len(x) - p.no, len(y) - q.no) if n is None else n

    assert [r.lcp for r in got] == [0, *(shared(p, q) for p, q in itertools.pairwise(got))]
    assert max(r.lcp for r in got) == 1_100


def test_repeated_runs(spark):
    docs = frame(spark, [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny\na\nb\nc\nd\ne"), (3, "c\nd"), (4, "z\nz\nz\nz\nz")])
    runs = repeated_runs(with_lcp(suffix_array(line_ids(docs)[1]))).collect()
    assert {(r.id, r.start, r.n_lines, r.first_id, r.first_start) for r in runs} == {(2, 1, 3, 1, 1), (2, 5, 5, 1, 0), (4, 1, 3, 4, 0), (4, 2, 3, 4, 0)}


def test_line_dedup_odd_rows(spark):
    text = "a\nb\nc\nd"
    got = Counter((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup(frame(spark, [(None, text), (1, text), (1, text), (2, "a\nb"), (2, "x\n" + text)])).collect())
    assert got == Counter({(None, 0, text): 1, (1, 4, ""): 2, (2, 0, "a\nb"): 1, (2, 4, "x"): 1})
    assert sorted(r.n_removed for r in line_dedup(frame(spark, [(1, text), (1, text)])).collect()) == [0, 4]
    assert line_dedup(frame(spark, [])).collect() == []


def test_chats(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", None)]
    convs = {1: a, 2: a[:2], 3: a[:1], 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", "hi"), ("assistant", "hello"), ("user", "")], 7: [(None, "x" * 300_000)], None: [("user", "lone")]}
    rows = [(c, i, r, t, "x", 1) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(8, None, "user", "odd", "x", 1), (8, None, "user", "odd", "x", 1)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string, n int").repartition(4)).collect()}
    assert set(got) == {1, 5, 6, 7, None, 8} and (got[1].n_same, got[1].n_turns, got[8].n_turns) == (2, 3, 2)
    assert got[1].chat == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\n\n<|end|>\n" and got[7].n_chars == len(got[7].chat)
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_decontamination_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(14))
    broken = item.replace("q13", "zz").split()
    docs = [(1, LONG + "\n" + item.upper() + "\n" + LONG), (2, " ".join(broken)), (3, " ".join(item.split()[:8])), (4, None), (5, ""), (None, item), (6, "one two"), (6, "x one two"), (7, item), (7, item), (8, " ".join(item.split()[:9]) + " - " + " ".join(item.split()[5:]))]
    items = [(1, item), (2, None), (3, ""), (4, "One two"), (None, item + " more"), (5, item), (5, item)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, need string")
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in contaminated(frame(spark, docs), bench).collect()}
    want = leaks([(d, t) for d, t in docs if t != "x one two"], items)
    assert got == want and {d for d, _ in want} == {1, 2, 6, 7, 8, None}
    assert sorted(r.doc_id for r in decontaminated(frame(spark, docs), contaminated(frame(spark, docs), bench)).collect()) == [3, 4, 5]
    assert contaminated(frame(spark, []), bench).collect() == [] == contaminated(frame(spark, docs), bench.limit(0)).collect()


def test_decontamination_query(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet").select(i, "text").collect() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in op8_benchmark_decontamination(spark, data).collect()}
    assert got == leaks(docs, items) != {}


def check_shards(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_sharding_query(spark, data):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = op9_sharding(spark, data).collect()
    check_shards(rows, got, 40)
    source, n = {d: s for d, _, s in rows}, Counter(s for _, _, s in rows)
    held = Counter((r.shard, source[r.doc_id]) for r in got)
    assert all(abs(held[i, s] - n[s] / 40) <= 2 for i in range(40) for s in n)
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in op9_sharding(spark, data).collect()}


def test_sharding_odd_rows(spark):
    rows = [(d, t, "s" if d else None) for d, t in ROWS]
    check_shards(rows, interleaved_shards(frame(spark, ROWS), 5).collect(), 5)
    check_shards(rows, interleaved_shards(frame(spark, ROWS), 40).collect(), 40)
    assert interleaved_shards(frame(spark, [])).collect() == []


def test_null_ids_and_copies_spread_over_buckets(spark):
    """Ten thousand rows without an id and a copied row: keys differ with the text, copies are one entry with a count."""
    from pyspark.sql import functions as F

    from editlake.llm.common import shuffle_key, text_digest

    many = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.format_string("text %d", "id").alias("text"), F.lit("s").alias("source"))
    assert many.select(F.substring(shuffle_key("doc_id", "shard", text_digest()), 1, 2).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0] < 100
    copies = spark.range(6_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same words").alias("text"), F.lit("t").alias("source"))
    alone = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.format_string("one %d", "id").alias("source"))
    every = many.unionByName(copies).unionByName(alone)
    rows = [(r.doc_id, r.text, r.source) for r in every.collect()]
    got = interleaved_shards(every, 40).collect()
    check_shards(rows, got, 40)
    hot = Counter(r.shard for r in got if r.doc_id == 1 and r.size == 26)
    assert max(hot.values()) - min(hot.values()) <= 15  # the shards' borders move with the 400 single rows drawn to random places
    one = Counter(r.shard for r in got if r.size == 17)
    assert max(one.values()) < 40 and len(one) == 40
    mix = curriculum_mix(every.where("source <> 't' or doc_id is not null")).where("source_size = 12000").collect()
    assert len(mix) == 6_000 and {r.taken for r in mix} <= {2, 4} and abs(sum(r.taken for r in mix) - mix[0].target) < 2


def test_every_use_has_a_position(spark):
    """Uses lie where the integral of the source's weight asks for them; the mix is their order."""
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = curriculum_mix(df).collect()
    slope = {"a": 0.5, "b": 0.0, "c": -0.5}
    streams = defaultdict(list)
    for r in got:
        assert sum(u.words for u in r.uses) == r.taken and all(u.words == r.size for u in r.uses[:-1])
        assert [u.position for u in r.uses] == sorted(u.position for u in r.uses)
        streams["abc"[r.doc_id % 3], r.target] += [(u.position, u.words) for u in r.uses]
    for (source, target), uses in streams.items():
        at, a = 0, slope[source]
        for position, n in sorted(uses):
            y = (at + n / 2) / target
            assert abs((1 - a) * position + a * position**2 - y) < 1e-6
            at += n
    mixed = [r.doc_id for r in mixed_documents(df, curriculum_mix(df)).collect()]
    order = sorted((u.position, r.doc_id) for r in got for u in r.uses if 2 * u.words >= r.size)
    assert mixed == [d for _, d in order] and max(Counter(mixed).values()) == 2


def check_mix(rows, got):
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(words(t))) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    return targets(sizes), sizes


def test_mixing_query(spark, data):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = op10_source_mixing(spark, data).collect()
    want, sizes = check_mix(rows, got)
    source, taken = {d: s for d, _, s in rows}, Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    again = op10_source_mixing(spark, data).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in again]


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "d e", None), (None, "f g h i", "z"), (5, "j", "z"), (5, "j", "z"), (6, LONG, "w")]
    df = spark.createDataFrame([(d, t, s, 1.0, 2) for d, t, s in rows], "doc_id long, text string, source string, target double, size int")
    mix = curriculum_mix(df)
    got = mix.collect()
    want, _ = check_mix(rows, got)
    assert {r.doc_id: r.target for r in got} == pytest.approx({d: want[s] for d, _, s in rows})
    assert {r.doc_id: r.taken for r in got if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    used = Counter(r.doc_id for r in mixed_documents(df, mix).collect())
    assert not used[2] and not used[3] and used[None] and mixed_documents(df, mix).columns == df.columns
    assert curriculum_mix(df.limit(0)).collect() == []
