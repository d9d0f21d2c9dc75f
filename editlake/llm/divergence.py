"""How far the sources of a language are from each other: chi-square sums over term shares, exact in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.llm.common import checkpointed, small, text_of
from editlake.llm.wordbatch import Words, chunks
from editlake.operators.shared import scratch_path

#: Bytes between terms: a term is a run of `[^\x00-\x40\x5B-\x60\x7B-\x7F]`, that is of A-Z, a-z and what is not ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Documents of a language that a kept term is in, ranks reported of a group's terms, and the scale of the shares.
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Digests that a task remembers while it drops copies, and counts that it holds while it adds them up.
HELD, COUNTS = 1 << 16, 1 << 20
#: Repeated texts, and groups (lang, source), up to which their tables are broadcast; they are counted first.
TEXTS, BROADCAST = 1_000_000, 100_000


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, digest, ...) without those whose digest the task remembers."""
    seen: set = set()
    for batch in batches:
        fresh = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                fresh.append(i)
        if len(seen) > HELD:
            seen = set()
        yield batch.take(pa.array(fresh, pa.int64()))


def _added(group: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, term, n, docs, first place) with one entry for each group and term."""
    order = np.argsort(group * (int(term.max(initial=0)) + 1) + term, kind="stable")
    group, term = group[order], term[order]
    starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (term[1:] != term[:-1])])) if len(order) else order
    return group[starts], term[starts], np.add.reduceat(n[order], starts) if len(order) else n, np.add.reduceat(docs[order], starts) if len(order) else docs, order[starts]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, copies: array of (source, times), text) -> (lang, source, term, n, docs), added up over COUNTS entries or more."""
    numbers: dict[tuple, int] = {}
    held: list = []  # (group, n, docs, spelled term) of chunks

    def merged() -> tuple:
        spelled = pa.chunked_array([h[3] for h in held]).combine_chunks().dictionary_encode()
        term = spelled.indices.to_numpy().astype(np.int64)
        group, n, docs = (np.concatenate([h[i] for h in held]) for i in range(3))
        group, term, n, docs, _ = _added(group, term, n, docs)
        return group, n, docs, spelled.dictionary.take(pa.array(term))

    def sent(group: np.ndarray, n: np.ndarray, docs: np.ndarray, spelled: pa.Array) -> pa.RecordBatch:
        names = list(numbers)
        lang, source = (pa.array([k[i] for k in names], pa.string()).take(pa.array(group)) for i in range(2))
        return pa.RecordBatch.from_arrays([lang, source, spelled.cast(pa.string()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True)
        for some in chunks(rows, lambda r: len(r[2])):
            words = Words([r[2] for r in some], lower=True, between=BETWEEN)
            _, first, term = np.unique(words.hashes(), return_index=True, return_inverse=True)
            kinds = max(len(first), 1)
            pairs, n = np.unique(words.text_of_word() * kinds + term, return_counts=True)
            text, term = pairs // kinds, pairs % kinds
            shares = [[(numbers.setdefault((lang, c["source"]), len(numbers)), c["times"]) for c in copies] for lang, copies, _ in some]
            many = np.array([len(s) for s in shares])
            at = np.cumsum(many) - many
            group, times = np.array([c for s in shares for c in s], np.int64).reshape(-1, 2).T
            each = np.repeat(np.arange(len(text)), many[text])
            entry = at[text][each] + np.arange(len(each)) - np.repeat(np.cumsum(many[text]) - many[text], many[text])
            group, term, n, docs, _ = _added(group[entry], term[each], n[each] * times[entry], times[entry])
            held.append((group, n, docs, words.spelled(first[term])))
            if sum(len(h[0]) for h in held) > COUNTS:
                held = [merged()]
                if len(held[0][0]) > COUNTS // 2:
                    yield sent(*held[0])
                    held, numbers = [], {}
    if held:
        yield sent(*merged())


def term_counts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each source, partly added up.

    docs has lang, source, text, digest; copies counts them by lang, digest and source. Texts that a language has once
    are cut into terms where they lie. Of the others one copy is, and what it adds is weighted with the copies that each
    source has; only these move, each once from a partition, so a text that is a third of all rows is no large group.
    """
    repeated = copies.groupBy("lang", "digest").agg(F.sum("times").alias("all"), F.collect_list(F.struct("source", "times")).alias("copies")).where(F.col("all") > 1).drop("all")
    repeated = checkpointed(repeated)
    known = small(repeated, repeated.count(), TEXTS)
    alone = docs.join(known.select("lang", "digest"), ["lang", "digest"], "left_anti").select("lang", F.array(F.struct("source", F.lit(1).cast("long").alias("times"))).alias("copies"), "text")
    moved = docs.join(known, ["lang", "digest"]).select("lang", "digest", "copies", "text").mapInArrow(_once, "lang string, digest binary, copies array<struct<source: string, times: long>>, text string")
    both = alone.unionByName(moved.dropDuplicates(["lang", "digest"]).drop("digest"))
    return both.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact at any count; 0 where a language keeps no term."""
    return F.when(terms > 0, F.call_function("div", _wide(F.lit(SCALE)) * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)")) + 1).otherwise(0)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits a long."""
    return F.when(q > 0, F.call_function("div", (p - q) * (p - q), q)).otherwise(0)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to every other one (part `pair`)
    and the terms that it uses more than the language does (part `term`, up to `top`).

    Null lang, source and text are read as ''. A language keeps the terms in at least `min_docs` of its documents. The
    sum over all kept terms is worked out sparsely: terms that neither source has add one constant each, terms that
    one has add what their count gives (a histogram of counts for each source), and only terms in both are joined.
    Groups without terms have all pairs too, with value 0 where the language keeps no term; repeated rows and copies
    count as documents; equal values are ordered by the item. An empty table gives no rows; other columns are ignored.
    """
    given = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    copies = checkpointed(given.groupBy("lang", "digest", "source").agg(F.count("*").alias("times")))
    met = term_counts(given, copies).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    first = F.row_number().over(of_term.orderBy("source")) == 1
    marked = met.withColumns({"all_docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "first": first})
    path = scratch_path(docs.sparkSession, "terms")
    marked.where(F.col("all_docs") >= min_docs).drop("docs", "all_docs").write.parquet(path)
    used = docs.sparkSession.read.parquet(path)

    every = copies.select("lang", "source").distinct()
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("have"), F.count_if("first").alias("terms"))
    of_lang = sums.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("total").alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = every.join(sums.drop("terms"), ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *map(zero, ("total", "have", "terms", "all")))
    groups = checkpointed(groups.withColumn("none", _share(F.lit(0), F.col("total"), F.col("terms"))))
    n_groups = groups.count()
    totals = small(groups.drop("have"), n_groups, BROADCAST)
    shares = used.join(totals, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))

    # pairs of sources: what terms of both, of the first, of the second and of neither add
    a = shares.select("lang", "term", F.col("source").alias("g"), "p", F.col("none").alias("none_g"))
    b = shares.select("lang", "term", F.col("source").alias("h"), F.col("p").alias("q"), F.col("none").alias("none_h"))
    p, q, none_g, none_h = map(F.col, ("p", "q", "none_g", "none_h"))
    both = a.join(b, ["lang", "term"]).where("g <> h").groupBy("lang", "g", "h").agg(F.count("*").alias("shared"), F.sum(_gap(p, q) - _gap(p, none_h) - _gap(none_g, q)).alias("joint"))
    counts = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    left = groups.select("lang", F.col("source").alias("g"), F.col("none").alias("none_g"), F.col("have").alias("have_g"))
    right = groups.select("lang", F.col("source").alias("h"), F.col("none").alias("none_h"), F.col("have").alias("have_h"), "terms")
    others = left.join(small(right, n_groups, BROADCAST), "lang").where("g <> h")
    alone = lambda name, other, gap: counts.withColumnRenamed("source", name).join(small(groups.select("lang", F.col("source").alias(other), F.col("none").alias("lone")), n_groups, BROADCAST), "lang").where("g <> h").groupBy("lang", "g", "h").agg(F.sum(F.col("times") * gap).alias(f"only_{name}"))
    only_g = alone("g", "h", _gap(p, F.col("lone")))
    only_h = alone("h", "g", _gap(F.col("lone"), p))
    on = ["lang", "g", "h"]
    known = others.join(both, on, "left").join(only_g, on, "left").join(only_h, on, "left").na.fill(0, ["shared", "joint", "only_g", "only_h"])
    neither = F.col("terms") - F.col("have_g") - F.col("have_h") + F.col("shared")
    value = F.col("joint") + F.col("only_g") + F.col("only_h") + neither * _gap(none_g, none_h)
    pairs = known.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), value.cast("long").alias("value"))

    # terms: against the whole language
    against = shares.withColumn("q", _share(F.col("n_lang"), F.col("all"), F.col("terms")))
    terms = against.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(p, q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
