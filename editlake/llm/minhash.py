"""MinHash near-duplicates with tensored bands: keys of tables are pairs from two small collections of hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlake.llm.common import checkpointed, small, text_of
from editlake.llm.wordbatch import BYTES, Words, chunks, mixed, rolled

SHINGLE, PERCENT = 2, 80
#: Each of two collections holds MEMBERS keys of ROWS minhashes; a table for each pair (i, j) has key i of the first and key j of the
#: second: MEMBERS ** 2 = 256 tables of 2 * ROWS = 6 minhashes out of 2 * MEMBERS * ROWS = 96 computed ones, not 1536. Two sets
#: that are 0.8 similar meet in a table unless all 16 keys of a collection differ: (1 - 0.8 ** 3) ** 16 = 1e-5 for each collection.
MEMBERS, ROWS = 16, 3
#: Longs in the bit pattern of a set.
WORDS = 32
#: Live texts up to which their digests are broadcast (counted first), 16 bytes each.
BROADCAST = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mixed(np.arange(1, 4 * MEMBERS * ROWS + 1, dtype=np.uint64) * _MIX)


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; a text with fewer words is one shingle."""
    words = Words(texts, lower=True)
    n = np.where(words.n > 0, np.maximum(words.n - shingle + 1, 1), 0)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    step = 1 << 18
    text = np.repeat(np.arange(len(n)), n)
    first = words.first[text] + np.arange(len(text)) - at[text]
    last = np.minimum(first + shingle, words.first[text + 1]) - 1
    h = np.empty(len(text), np.uint64)
    for i in range(0, len(h), step):
        s, e = words.start[first[i : i + step]], words.end[last[i : i + step]]
        if len(s):
            h[i : i + step] = rolled(words.buffer[s[0] : e[-1]].astype(np.uint64), s - s[0], e - s[0], BYTES)
    for i in range(len(n)):
        yield np.unique(h[at[i] : at[i + 1]])


def sketch(sets: list[np.ndarray], members: int = MEMBERS, rows: int = ROWS) -> np.ndarray:
    """(sets, 2 * members) keys: each is a hash of `rows` minhashes and of its place. Empty sets have zeros."""
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sets), 2 * members), np.uint64)
    if not len(some):
        return out
    flat, starts = np.concatenate([sets[i] for i in some]), np.cumsum(sizes[some]) - sizes[some]
    for key in range(2 * members):
        made = np.full(len(some), key + 1, np.uint64)
        for r in range(rows):
            salt = _SALTS[2 * (key * rows + r)], _SALTS[2 * (key * rows + r) + 1] | np.uint64(1)
            v = (flat ^ salt[0]) * salt[1]
            v ^= v >> np.uint64(32)
            made = mixed(made * _MIX + np.minimum.reduceat(v * salt[1], starts))
        out[some, key] = made
    return out


def _sketches(shingle: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)
            done = 0
            for some in chunks(rows, lambda r: len(r[0])):
                sets = list(shingle_sets([t for t, _ in some], shingle))
                names = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                keys = pa.array(sketch(sets).view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * MEMBERS), keys)
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(some)), pa.array([d for _, d in some], pa.binary()), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists], ["id", "digest", "name", "n", "keys"])
                done += len(some)

    return of


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """64 * WORDS bits of which a set sets one for each shingle."""
    marked = np.zeros(64 * WORDS, bool)
    marked[(hashes >> np.uint64(20)).astype(np.int64) % (64 * WORDS)] = True
    return np.packbits(marked).view(np.int64)


def _sets(shingle: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()
        for batch in batches:
            for some in chunks(iter(batch.column(0).cast(pa.binary()).to_pylist()), len):
                sets = [(hashlib.md5(s.tobytes()).digest(), s) for s in shingle_sets(some, shingle) if len(s)]
                fresh = {name: made for name, made in sets if name not in held}
                if len(held) > 1 << 16:
                    held = set()
                held |= fresh.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array([s.view(np.int64) for s in fresh.values()], pa.list_(pa.int64())), pa.array([bits_of(s) for s in fresh.values()], pa.list_(pa.int64()))], ["name", "made", "bits"])

    return of


def _near_in_order(window: int, percent: int):
    """Pairs of rows (key, place, n, name, label) at most `window` apart in their order that share the key but no label yet."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([last, now]).combine_chunks() if last is not None else now
            key, n = (now.column(c).to_numpy() for c in ("key", "n"))
            label = now.column("label").to_numpy(zero_copy_only=False)
            held = 0 if last is None else len(last)
            a, b = [], []
            for step in range(1, min(window, len(now) - 1) + 1):
                low = np.arange(max(0, held - step), len(now) - step)
                m, k = n[low], n[low + step]
                met = low[(key[low] == key[low + step]) & (100 * np.minimum(m, k) >= percent * np.maximum(m, k)) & (label[low] != label[low + step])]
                a.append(met), b.append(met + step)
            if a:
                x, y = (now.column("name").take(pa.array(np.concatenate(s))).combine_chunks() for s in (a, b))
                yield pa.RecordBatch.from_arrays([x, y], ["x", "y"])
            last = now.slice(max(0, len(now) - window))

    return of


def _similar(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, sides = [], [batch.column(f"made_{s}") for s in "ab"]
            values, ends = [c.values.to_numpy() for c in sides], [c.offsets.to_numpy() for c in sides]
            for i in range(batch.num_rows):
                s = np.sort(np.concatenate([v[e[i] : e[i + 1]] for v, e in zip(values, ends, strict=True)]))
                shared = int((s[1:] == s[:-1]).sum())
                ok.append(100 * shared >= percent * (len(s) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return of


def _live(entries: DataFrame) -> DataFrame:
    """name, entries: of each set the keys (place, key) under which a set of another label stands too."""
    mixed_keys = entries.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    kept = entries.join(mixed_keys.hint("merge"), "key", "left_semi")
    sides = kept.groupBy("name", "n", "label").agg(F.collect_set(F.struct("place", "key")).alias("entries"))  # at most 2 * MEMBERS
    side = lambda e, second: F.filter(e, lambda x: (x["place"] >= MEMBERS) == F.lit(second))
    both = sides.withColumn("first", side(F.col("entries"), False)).withColumn("second", side(F.col("entries"), True))
    return both.where("size(first) > 0 and size(second) > 0").drop("entries")


def _tables(live: DataFrame) -> DataFrame:
    """key, place, n, name, label: a row for each table (i, i), in a random order inside a table."""
    pair = lambda x, y: F.xxhash64(x["key"], y["key"])
    match = lambda x: F.filter("second", lambda y: y["place"] - MEMBERS == x["place"])
    keys = F.flatten(F.transform("first", lambda x: F.transform(match(x), lambda y: pair(x, y))))
    return live.select(F.explode(keys).alias("key"), "n", "name", "label").withColumn("place", F.xxhash64("key", "name"))


def _unlike(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """name: sets of which so many shingles are in no other live set that none can be similar enough: |a & b| / |a | b| <= (n - alone) / n."""
    names = [F.xxhash64("name").alias("a"), F.xxhash64(F.lit(1), "name").alias("b")]
    tokens = sets.join(live.select("name").hint("merge"), "name").select(*names, F.explode("made").alias("t"))
    alone = tokens.groupBy("t").agg(F.count("*").alias("c"), F.min("a").alias("a"), F.min("b").alias("b")).where("c = 1").groupBy("a", "b").agg(F.count("*").alias("alone"))
    return live.select("name", "n", *names).join(alone.hint("merge"), ["a", "b"]).where(100 * (F.col("n") - F.col("alone")) < percent * F.col("n")).select("name")


def _may_be_similar(percent: int) -> Column:
    """Whether the bits of two sets leave room for the similarity: a bit that only one has is a shingle that only it has."""
    apart = lambda x, y: sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(WORDS)), F.lit(0))
    shared = F.least(F.col("n") - apart("bits", "its_bits"), F.col("its_n") - apart("its_bits", "bits"))
    return 100 * shared >= percent * (F.col("n") + F.col("its_n") - shared)


def _rest(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs x, y of different labels that stand together in some table (i, j) and may be similar, each once.

    Two sets share a table if they share key i of the first collection and key j of the second: they are joined on the
    first, and the second is compared in the join, so that the tables need not be written out. A pair counts at its
    smallest common key. Under a key the sets beside its commonest label meet all others.
    """
    known = live.join(sets.select("name", "bits").hint("merge"), "name")
    rows = checkpointed(known.select("name", "n", "label", "bits", F.col("first.key").alias("firsts"), F.col("second.key").alias("seconds")).withColumn("key", F.explode("firsts")))
    most = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    placed = rows.join(most.hint("merge"), "key")
    few = placed.where("label <> most").select("key", *(F.col(c).alias(f"its_{c}") for c in ("name", "n", "label", "bits", "firsts", "seconds")))
    sized = (100 * F.least("n", "its_n") >= percent * F.greatest("n", "its_n")) & (F.col("label") != F.col("its_label"))
    once = (F.col("label") == F.col("most")) | (F.col("name") < F.col("its_name"))
    met = F.arrays_overlap("seconds", "its_seconds") & (F.array_min(F.array_intersect("firsts", "its_firsts")) == F.col("key"))
    return placed.join(few.hint("merge"), "key").where(sized & once & met & _may_be_similar(percent)).select(F.col("name").alias("x"), F.col("its_name").alias("y"))


def _entries(live: DataFrame) -> DataFrame:
    return live.select("name", "n", F.explode(F.concat("first", "second")).alias("e")).select("name", "n", "e.*")


def dense_labels(links: DataFrame) -> DataFrame:
    """name, label: the smallest name that each linked one reaches. Minima travel; from the third round on paths halve too.

    Links hold their own ends as well, so a round is one join and one sum; groups linked at random settle in a few.
    """
    x, y = F.col("a").alias("x"), F.col("b").alias("y")
    ways = [links.select(x, y), *(links.select(F.col(s).alias("x"), F.col(t).alias("y")) for s, t in ("ba", "aa", "bb"))]
    both = checkpointed(ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3]).distinct())
    label = checkpointed(both.groupBy(F.col("x").alias("name")).agg(F.min("y").alias("label")))
    rounds = 0
    while True:
        near = both.join(label.select(F.col("name").alias("y"), "label").hint("merge"), "y")
        step = near.groupBy(F.col("x").alias("name")).agg(F.max(F.when(F.col("x") == F.col("y"), F.col("label"))).alias("old"), F.min("label").alias("label"))
        if rounds > 1:
            far = label.select(F.col("name").alias("label"), F.col("label").alias("far")).hint("merge")
            step = step.join(far, "label", "left").select("name", "old", F.least("label", "far").alias("label"))
        label, rounds = checkpointed(step), rounds + 1
        if label.where("label <> old").isEmpty():
            return label.select("name", "label")


def linked_labels(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """name, label (the smallest name reachable) of all sets that are linked with another one.

    First neighbours in a random order of each table (i, i) are compared: in a large group they make a graph of small
    diameter that holds nearly all of it. Then a key under which all sets have one label is left out, so a group of
    copies costs a few comparisons for each member, and so is a set that too many shingles of its own keep apart from
    all others, which most of those are that a large group has left over. Last comes every pair of every table whose
    sets have different labels still and whose bits leave room for the similarity.
    """
    side = lambda s: sets.select(F.col("name").alias(s), F.col("made").alias(f"made_{s}")).hint("merge")

    def similar(met: DataFrame) -> DataFrame:
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        checked = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar(percent), "a binary, b binary, ok boolean")
        return checkpointed(checked.where("ok").select("a", "b"))

    rows = checkpointed(_tables(live)).repartitionByRange("key", "place").sortWithinPartitions("key", "place")
    links = similar(rows.mapInArrow(_near_in_order(1, percent), "x binary, y binary"))
    labels = dense_labels(links)
    apart = live.join(_unlike(live, sets, percent).hint("merge"), "name", "left_anti")
    left = checkpointed(_live(_entries(apart).join(labels.hint("merge"), "name", "left").withColumn("label", F.coalesce("label", "name"))))
    more = similar(_rest(left, sets, percent))
    return labels if more.isEmpty() else dense_labels(links.unionByName(more))


def minhash_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose sets of word shingles are linked by steps of a Jaccard similarity of `percent` or more.

    Equal sets are one point, so copies cost nothing after the first pass. Points that share a table of the tensored
    bands are candidates; each link is confirmed on the full sets (64-bit hashes of shingles). A link of similarity
    0.8 is missed with a chance of about 2e-5, a closer one less often.

    Returns id, n_shingles, component_id (smallest id reachable), kept (id is that one), one row per input row. A-Z are
    lower-cased; a text with fewer words than a shingle is one shingle; null texts and texts without words have no
    shingle and are groups of their own, each row of them. Null ids are no smallest id unless a group has no other, and
    such a row is kept. Rows of one id and one text are all kept or all not. An empty table gives no rows; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.unhex(F.md5("text"))
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    marked = checkpointed(given.select("id", "text", digest.alias("digest")).mapInArrow(_sketches(shingle), f"id {kind}, digest binary, name binary, n long, keys array<long>"))
    sets_of = marked.where("n > 0")
    live = checkpointed(_live(sets_of.select("name", "n", F.col("name").alias("label"), F.posexplode("keys").alias("place", "key"))))
    where = sets_of.groupBy("name").agg(F.min("id").alias("component_id"))
    if not live.isEmpty():
        wanted = checkpointed(sets_of.join(live.select("name"), "name", "left_semi").groupBy("name").agg(F.min("digest").alias("digest")).select("digest"))
        texts = given.withColumn("digest", digest).join(small(wanted, wanted.count(), BROADCAST), "digest", "left_semi").select("text")
        sets = checkpointed(texts.mapInArrow(_sets(shingle), "name binary, made array<long>, bits array<long>").dropDuplicates(["name"]))
        placed = where.join(linked_labels(live, sets, percent), "name", "left").withColumn("label", F.coalesce("label", "name"))
        where = placed.select("name", "label").join(placed.groupBy("label").agg(F.min("component_id").alias("component_id")), "label").select("name", "component_id")
    joined = marked.select("id", "name", "n").join(where, "name", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
