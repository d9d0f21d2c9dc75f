import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from editlake.llm import divergence
from editlake.llm.divergence import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    docs, count, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        docs.update((lang, t) for t in set(terms))
        for t in terms:
            count[lang, source, t] += 1
            count[lang, None, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (n, t), c in docs.items() if n == lang and c >= least]
        total = {s: sum(count[lang, s, t] for t in kept) for s in [*sources, None]}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 1) // (total[s] + len(kept)) for s in total for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = [(-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s, t], p[None, t]), t.encode(), t) for t in kept if count[lang, s, t] and p[s, t] > p[None, t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def result(df, **more):
    rows = [tuple(r) for r in source_divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def drawn(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"{'ABcd'[i % 4]}w{chr(97 + i % 26)}{'é' * (i % 3)}" for i in range(90)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randrange(30))) for _ in range(n)]
    return [(i, draw.choice(texts), draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "Ä", None])) for i in range(n)]


def test_against_brute_force(spark):
    rows = drawn(400, 1)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def test_forgotten_digests_and_flushed_counters_change_nothing(spark, monkeypatch):
    rows = drawn(300, 2)
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "COUNTS", 5)
    monkeypatch.setattr(divergence, "BROADCAST", 0)
    monkeypatch.setattr(divergence, "TEXTS", 0)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(2), top=7) == brute(rows, top=7)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "1 2 3 ._", "en", "b"), (None, "Once", "en", "c"), (5, "once ONCE", "en", "c"), (5, "once ONCE", "en", "c"), (6, "x", "de", "a"), (7, "long " * 50_000, "en", "a")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA + ", n long, term string")
    got = result(df)
    assert got == brute(rows) and ("en", "a", "pair", "b", 0, 1) in got
    assert result(df.where("lang = 'de'")) == set() and result(df.limit(0)) == set()


def test_a_language_without_kept_terms_has_its_pairs(spark):
    rows = [(i, f"own{i}", "en", s) for i, s in enumerate("abc")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == {("en", s, "pair", o, 0, r + 1) for s in "abc" for r, o in enumerate(x for x in "abc" if x != s)}


def test_copies_travel_once_from_a_partition(spark):
    """A third of all rows is one text: it leaves each partition once, and texts without copies do not move."""
    rows = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words").otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    sent = rows.select("lang", F.md5("text").cast("binary").alias("digest"), "text").mapInArrow(divergence._once, "lang string, digest binary, text string")
    assert sent.where("text = 'the same words'").count() == 4 and sent.count() == 4 * 51
    assert result(rows) == brute([tuple(r) for r in rows.collect()])
