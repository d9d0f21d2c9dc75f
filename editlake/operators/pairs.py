"""Construction of pairs by shuffle joins on shared keys."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlake.functions.sequence import char, hamming_distance, places
from editlake.operators.ordering import exact_rank, md5_key, running_total
from editlake.operators.relational import dictionary, first_per_key
from editlake.operators.shared import checkpointed

#: Letters up to which sequences are compared by masked places.
SHORT = 12
#: Members of a core that one join key holds on its left side.
CORE_PART = 1000
#: Buckets in which items are counted for their order (16 bits), and the share of the least overlap that is asked for among the first ones.
BUCKETS, EXTRA = 1 << 16, 0.1
#: Different items up to which sets are compared as bits, and sets of a block.
DENSE_ITEMS, BIT_BLOCK = 512, 8192


def capped_cores(fragments: DataFrame, cap: int, seed: str = "cap") -> DataFrame:
    """At most `cap` members of each core, in seeded order: the guard against skew of the pair join."""
    ranked = exact_rank(fragments, md5_key(seed, "mol_id"), ["mol_id"], "__r", ("core",))
    return ranked.where(F.col("__r") < cap).select(*fragments.columns)


def mmp_pairs(fragments: DataFrame, molecules: DataFrame, max_mw_delta: float = 200, min_mols: int = 10, cap: int | None = 1000, once: bool = False, carry: tuple[str, ...] = (), a: str | None = None, b: str | None = None) -> DataFrame:
    """Unordered pairs of molecules with a common core and nearly the same mass.

    Cores with fewer than `min_mols` members are left out, larger ones than `cap` sampled down. The join is on the core
    and a mass band: bins of the band's width make neighbours meet in one bin or the next. Where the band is wide, a large
    core is spread over join keys by parts of about CORE_PART members, each of which meets all members.

    `once`: each pair only with its smallest core and the first chain of each molecule in it (see smallest_core), without
    a shuffle of pairs: a member knows the hashes of its molecule's smaller cores, and two members that share one of
    them make no pair here. Columns of `molecules` named in `carry` come with both sides, as <name>_a and <name>_b.

    `a`, `b`: conditions on the members that may be a pair's first or second one, for few of them: cores are not cut into
    parts then, and only those of the few are joined.
    """
    known = molecules.where("mw is not null").select("mol_id", "mw", *carry)
    counts = fragments.groupBy("core").count().where(F.col("count") >= min_mols)
    bins = fragments.join(known.select("mol_id", F.floor(F.col("mw") / max_mw_delta).alias("bin")), "mol_id").groupBy("core", "bin").agg(F.count("*").alias("n"))
    parts = bins.groupBy("core").agg(F.ceil(F.max("n") / CORE_PART).cast("int").alias("parts"))
    large = counts.select("core", F.lit(1).alias("parts")) if a or b else counts.select("core").join(parts, "core")
    sized = fragments.join(known.select("mol_id"), "mol_id", "left_semi").join(large, "core")
    if cap:
        sized = capped_cores(sized, cap)
    more = ["smaller", "parts_of"] if once else []
    members = (_smaller_cores(sized) if once else sized).join(known, "mol_id")
    binned = members.withColumn("bin", F.floor(F.col("mw") / max_mw_delta))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("mol_id", "chain", "mw", *more, *carry)]
    first, second = binned.where(a) if a else binned, binned.where(b) if b else binned
    if a:
        second = second.join(first.select("core").distinct(), "core", "left_semi")
    if b:
        first = first.join(second.select("core").distinct(), "core", "left_semi")
    left = first.select("core", F.pmod(F.xxhash64("mol_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), *side("a"))
    right = second.select("core", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "bin", *side("b"))
    close = (F.col("mol_id_a") < F.col("mol_id_b")) & (F.abs(F.col("mw_a") - F.col("mw_b")) <= max_mw_delta)
    if once:
        close = close & ~F.arrays_overlap("smaller_a", "smaller_b")
    found = left.join(right, ["core", "part", "bin"]).where(close)
    returned = [F.col(f"{c}_{s}") for c in ("chain", *more[1:], *carry) for s in "ab"]
    return found.select("core", F.col("mol_id_a").alias("mol_a"), F.col("mol_id_b").alias("mol_b"), *returned)


def pairs_of_rows(fragments: DataFrame, molecules: DataFrame, rows: DataFrame, on: list[str], max_mw_delta: float = 200, min_mols: int = 10) -> DataFrame:
    """Rows of two molecules that make a pair and agree in `on`: mol_a, mol_b, `on`, and the other columns of both rows.

    Pairs are those of mmp_pairs(cap=None, once=True). They are not made first: rows meet on the core and `on` together, so
    the work follows the rows returned, not the pairs of molecules.
    """
    known = molecules.where("mw is not null").select("mol_id", "mw")
    many = fragments.groupBy("core").count().where(F.col("count") >= min_mols).select("core", F.lit(1).alias("parts"))
    members = _smaller_cores(fragments.join(known.select("mol_id"), "mol_id", "left_semi").join(many, "core")).join(known, "mol_id").select("mol_id", "core", "mw", "smaller")
    more = [c for c in rows.columns if c not in ("mol_id", *on)]
    each = members.join(rows.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in on))), "mol_id")
    a, b = (each.select("core", *on, *(F.col(c).alias(f"{c}_{s}") for c in ("mol_id", "mw", "smaller", *more))) for s in "ab")
    close = (F.col("mol_id_a") < F.col("mol_id_b")) & (F.abs(F.col("mw_a") - F.col("mw_b")) <= max_mw_delta) & ~F.arrays_overlap("smaller_a", "smaller_b")
    return a.join(b, ["core", *on]).where(close).select(F.col("mol_id_a").alias("mol_a"), F.col("mol_id_b").alias("mol_b"), *on, *(f"{c}_{s}" for c in more for s in "ab"))


def class_pairs(fragments: DataFrame, molecules: DataFrame, max_mw_delta: float = 200, min_mols: int = 10) -> tuple[DataFrame, DataFrame]:
    """(members, pairs of classes), for what asks only which kinds of pairs mmp_pairs(cap=None, once=True) has, in either order.

    Members of a core with the same chain, mass and smaller cores are a class: each of one class makes a pair with each of
    another one or none does. Members have mol_id and class, class pairs class_a, class_b, core, chain_a, chain_b, parts_of_a,
    parts_of_b, each pair of unlike classes once. Where all masses of a core lie within the band, mass tells no classes apart.
    """
    known = molecules.where("mw is not null").select("mol_id", "mw")
    many = fragments.groupBy("core").count().where(F.col("count") >= min_mols).select("core", F.lit(1).alias("parts"))
    one = _smaller_cores(fragments.join(known.select("mol_id"), "mol_id", "left_semi").join(many, "core")).join(known, "mol_id")
    wide = one.groupBy("core").agg((F.max("mw") - F.min("mw") > max_mw_delta).alias("wide"))
    mass = F.when(F.col("wide"), F.col("mw"))
    members = checkpointed(one.join(wide, "core").select("mol_id", "core", "chain", "parts_of", F.array_sort("smaller").alias("smaller"), mass.alias("mass")).withColumn("class", F.sha2(F.to_json(F.struct("core", "chain", "smaller", "mass")), 256)))
    classes = members.groupBy("class").agg(*(F.first(c).alias(c) for c in ("core", "chain", "parts_of", "smaller", "mass")))
    a, b = (classes.select("core", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "chain", "parts_of", "smaller", "mass"))) for s in "ab")
    near = F.coalesce(F.abs(F.col("mass_a") - F.col("mass_b")) <= max_mw_delta, F.lit(True))
    met = a.join(b, "core").where((F.col("class_a") < F.col("class_b")) & near & ~F.arrays_overlap("smaller_a", "smaller_b"))
    return members.select("mol_id", "class"), met.select("class_a", "class_b", "core", "chain_a", "chain_b", "parts_of_a", "parts_of_b")


def _smaller_cores(members: DataFrame) -> DataFrame:
    """Each molecule once in each of its cores, with its first chain there, the parts of it in order, and hashes of its smaller cores."""
    each = members.groupBy("mol_id", "core", "parts").agg(F.min("chain").alias("chain"))
    listed = each.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("core", "chain", "parts"))).alias("all"))
    one = listed.select("mol_id", "all", F.posexplode("all").alias("k", "c"))
    before = F.transform(F.slice("all", F.lit(1), F.col("k")), lambda c: F.xxhash64(c["core"]))
    return one.select("mol_id", "c.*", before.alias("smaller"), F.sort_array(F.array_distinct(F.split("c.chain", "\\."))).alias("parts_of"))


def smallest_core(pairs: DataFrame) -> DataFrame:
    """Each pair once, with its smallest core."""
    best = F.min(F.struct("core", "chain_a", "chain_b")).alias("best")
    return pairs.groupBy("mol_a", "mol_b").agg(best).select("mol_a", "mol_b", "best.*")


def edit_columns(a: Column, b: Column) -> list[Column]:
    """edit (from>>to) and num_cuts of two sorted lists of parts; parts they share are no edit."""
    before, after = F.array_except(a, b), F.array_except(b, a)
    return [F.concat(F.array_join(before, "."), F.lit(">>"), F.array_join(after, ".")).alias("edit"), F.greatest(F.size(before), F.size(after)).alias("num_cuts")]


def with_edits(pairs: DataFrame, max_cuts: int | None = None) -> DataFrame:
    """Pairs that differ, with their edit; at most `max_cuts` parts on a side."""
    if "parts_of_a" not in pairs.columns:
        pairs = pairs.withColumns({f"parts_of_{s}": F.sort_array(F.array_distinct(F.split(f"chain_{s}", "\\."))) for s in "ab"})
    differ = pairs.where("chain_a <> chain_b")
    if max_cuts:
        differ = differ.where((F.size(F.array_except("parts_of_a", "parts_of_b")) <= max_cuts) & (F.size(F.array_except("parts_of_b", "parts_of_a")) <= max_cuts))
    differ = differ.where(F.array_remove("parts_of_a", "") != F.array_remove("parts_of_b", ""))  # where the edit is not '>>', without working it out twice
    return differ.select("*", *edit_columns(F.col("parts_of_a"), F.col("parts_of_b"))).drop("parts_of_a", "parts_of_b")


def value_maps(values: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """mol_id, values: for each molecule a map from what `on` names to its one value there; nulls are left out."""
    key = F.col(on[0]) if len(on) == 1 else F.struct(*on)
    known = values.where(F.col(value).isNotNull() & key.isNotNull())
    return known.groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), F.col(value).alias("value")))).alias("values"))


def expand_values(pairs: DataFrame, on: list[str]) -> DataFrame:
    """Pairs with both members' maps (values_a, values_b) -> one row per pair and property that both have, delta = b - a."""
    rest = [c for c in pairs.columns if c not in ("values_a", "values_b")]
    rows = pairs.select(*rest, "values_b", F.explode("values_a").alias("__key", "value_a")).withColumn("value_b", F.try_element_at("values_b", F.col("__key"))).where("value_b is not null")
    names = [F.col("__key").alias(on[0])] if len(on) == 1 else [F.col(f"__key.{c}").alias(c) for c in on]
    return rows.select(*rest, *names, "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"))


def with_values(pairs: DataFrame, values: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """One row per pair and property that both members have: value_a, value_b, delta = b - a; nulls are dropped.

    A molecule has one value for each `on`. Its values travel as one map, so pairs are joined on molecules alone and
    expanded last; where pairs are made from molecules that carry the map (mmp_pairs), expand_values needs no join.
    """
    maps = value_maps(values, on, value)
    side = lambda s: maps.select(F.col("mol_id").alias(f"mol_{s}"), F.col("values").alias(f"values_{s}"))
    return expand_values(pairs.join(side("a"), "mol_a").join(side("b"), "mol_b"), on)


def spread_values(values: DataFrame, on: str, names: list[str], value: str = "value") -> DataFrame:
    """mol_id, and for each name the molecule's one value there, under value_<number of the name>; null where it has none."""
    return values.groupBy("mol_id").agg(*(F.max(F.when(F.col(on) == name, F.col(value))).alias(f"value_{i}") for i, name in enumerate(names)))


def membership_masks(df: DataFrame, item: str, group: str) -> tuple[DataFrame, list[str], DataFrame]:
    """(masks, names of their columns, groups): each item's groups as bits of longs, bit i of word w being group 64 w + i.

    groups has (value, id), ids in the order of values; there are as many columns as 64 goes into their number.
    """
    groups = checkpointed(dictionary(df, group))
    words = [f"mask_{w}" for w in range(max(1, -(-groups.count() // 64)))]
    bits = df.select(item, F.col(group).alias("value")).join(groups, "value").select(item, F.expr("id div 64").alias("w"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bit"))
    masks = bits.groupBy(item).agg(*(F.coalesce(F.bit_or(F.when(F.col("w") == k, F.col("bit"))), F.lit(0)).cast("long").alias(name) for k, name in enumerate(words)))
    return masks, words, groups


def shared_groups(words: list[str]) -> list[Column]:
    """The groups that both members of a pair have, as masks under the same names."""
    return [F.col(f"{w}_a").bitwiseAND(F.col(f"{w}_b")).alias(w) for w in words]


def mask_size(words: list[str]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(w) for w in words))


def mask_ids(words: list[str]) -> Column:
    """The ids of the groups in a mask."""

    def ids(word: str, base: int) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col(word), i) == 1), lambda i: i + base)

    return F.concat(*(ids(w, 64 * k) for k, w in enumerate(words)))


def dedup_pairs(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return first_per_key(df, key, *order)


def band_join(left: DataFrame, right: DataFrame, value: str, width: float, key: str) -> DataFrame:
    """Pairs key_a < key_b with |value_a - value_b| <= width, by equal or neighbouring bins."""
    bin_of = F.floor(F.col(value) / width)
    a = left.select(F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("__bin"), *(F.col(c).alias(f"{c}_a") for c in left.columns))
    b = right.select(bin_of.alias("__bin"), *(F.col(c).alias(f"{c}_b") for c in right.columns))
    near = (F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.abs(F.col(f"{value}_a") - F.col(f"{value}_b")) <= width)
    return a.join(b, "__bin").where(near).drop("__bin")


def set_tokens(sets: DataFrame, key: str, items: str) -> DataFrame:
    """key, size, tokens: the distinct items of each set as numbers in one global order, rare ones first.

    Items are counted in BUCKETS by their 64-bit hash; a token is the rank of its bucket and the rest of the hash, so it is
    both the item's place in the order and the item itself. Only the ranks, of a fixed number, pass the driver.
    """
    hashed = sets.select(key, F.transform(F.array_distinct(items), lambda i: F.xxhash64(i)).alias("tokens")).where(F.size("tokens") > 0)
    hashed = checkpointed(hashed)
    counts = hashed.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(BUCKETS - 1).alias("bucket")).count().collect()
    seen = np.zeros(BUCKETS, np.int64)
    for r in counts:
        seen[r["bucket"]] = r["count"]
    rank = np.empty(BUCKETS, np.int64)
    rank[np.lexsort((np.arange(BUCKETS), seen))] = np.arange(BUCKETS) - BUCKETS // 2
    high = rank << 48

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            at = at - at[0]
            made = high[flat & (BUCKETS - 1)] | (flat.view(np.uint64) >> np.uint64(16)).view(np.int64)
            made = made[np.lexsort((made, np.repeat(np.arange(len(at) - 1), np.diff(at))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(made))], [key, "size", "tokens"])

    kind = sets.schema[key].dataType.simpleString()
    return hashed.mapInArrow(ordered, f"{key} {kind}, size int, tokens array<long>")


def similar_candidates(tokens: DataFrame, key: str, threshold: float, within: str | None = None) -> DataFrame:
    """Pairs (x, y) of token sets that may have Jaccard >= threshold, and agree in `within`; a superset of all that do.

    Sets of sizes m and n share at least o = ceil(threshold (m + n) / (1 + threshold)) tokens then, so among their first
    m - o + l and n - o + l ones they share l: these are joined on the token, matches behind those places are left out
    and pairs with fewer than l matches too. l is EXTRA of o and one more: longer prefixes, far fewer candidates. Sizes
    are dealt into bins of the ratio 1 / threshold, so that sets of unlike sizes do not meet.
    """
    n, rank = F.col("size"), F.log("size") / math.log(1 / threshold) if threshold < 1 else F.col("size").cast("double")
    overlap = lambda size: F.ceil(threshold / (1 + threshold) * size - 1e-9).cast("int")
    wanted = lambda o: (F.floor(EXTRA * o) + 1).cast("int")
    first = lambda least: F.posexplode(F.slice("tokens", F.lit(1), F.least(n, n - least + wanted(least))))
    same = [within] if within else []
    small = tokens.select(F.col(key).alias("x"), *same, n.alias("m"), F.explode(F.sequence(F.floor(rank), F.floor(rank + 1 + 1e-9))).alias("bin"), first(overlap(2 * n)).alias("i", "token"))
    large = tokens.select(F.col(key).alias("y"), *same, n, F.floor(rank).alias("bin"), first(F.ceil(threshold * n - 1e-9).cast("int")).alias("j", "token"))
    both = overlap(F.col("m") + n)
    fits = (F.struct("m", "x") < F.struct("size", "y")) & (F.col("m") >= threshold * n - 1e-9)
    early = (F.col("i") < F.col("m") - both + wanted(both)) & (F.col("j") < n - both + wanted(both))
    met = small.join(large, ["token", "bin", *same]).where(fits & early)
    return met.groupBy("x", "y").agg(F.count("*").alias("matches"), F.max(wanted(both)).alias("least")).where("matches >= least").select("x", "y")


def set_similarity_join(sets: DataFrame, key: str, items: str, threshold: float, within: str | None = None) -> DataFrame:
    """Pairs key_a < key_b of item sets with Jaccard (Tanimoto) >= threshold, exact up to equal 64-bit hashes of items.

    Candidates come from counted prefix matches; only for them the tokens are read again and counted in full. Empty and
    null sets are in no pair; a null item is an item. Keys are distinct.

    `within`: a column in which both sets of a pair agree. Where it leaves fewer pairs than there are tokens, all these
    are counted as they meet, and sets alone with their value are left out at once.
    """
    if within:
        alike = sets.groupBy(within).agg(F.count("*").alias("__n")).where("__n > 1")
        sets = sets.join(alike.select(within), within, "left_semi")
    tokens = checkpointed(set_tokens(sets, key, items))
    if within:
        tokens = tokens.join(sets.select(key, within), key)
        few = alike.agg(F.coalesce(F.sum(F.expr("__n * (__n - 1) div 2")), F.lit(0))).first()[0] <= tokens.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if few:
            side = lambda s: tokens.select(within, F.col(key).alias(f"{key}_{s}"), F.col("tokens").alias(f"tokens_{s}"), F.col("size").alias(f"size_{s}"))
            fits = (F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9)
            met = side("a").join(side("b"), within).where(fits).withColumn("shared", F.size(F.array_intersect("tokens_a", "tokens_b")))
            similarity = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
            return met.select(f"{key}_a", f"{key}_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    full = lambda s: tokens.select(F.col(key).alias(s), F.col("tokens").alias(f"tokens_{s}"), F.col("size").alias(f"size_{s}"))
    found = similar_candidates(tokens, key, threshold, within).join(full("x"), "x").join(full("y"), "y")
    counted = found.withColumn("shared", F.size(F.array_intersect("tokens_x", "tokens_y")))
    similarity = F.col("shared") / (F.col("size_x") + F.col("size_y") - F.col("shared"))
    return counted.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def bit_similarity_join(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """set_similarity_join where all sets are made of few items (up to DENSE_ITEMS) and keys are whole numbers: exact, and without candidates.

    With few items every item is common, and shared ones tell little. Sets become bits, packed in blocks of BIT_BLOCK rows;
    each pair of blocks is one row of a fixed size, in which all sets of sizes that fit are compared by counts of common
    bits. The comparisons grow with the square of the rows; memory and what is shuffled stay small. Other sets take
    the general way.
    """
    found = sets.select(F.explode(items).alias("item")).where("item is not null").distinct().limit(DENSE_ITEMS + 1).collect()
    if not 0 < len(found) <= DENSE_ITEMS or sets.schema[key].dataType.typeName() not in ("long", "integer") or not sets.where(F.exists(items, lambda i: i.isNull())).isEmpty():
        return set_similarity_join(sets, key, items, threshold)
    place = {r["item"]: i for i, r in enumerate(found)}
    words = -(-len(place) // 64)
    known = sets.where(F.size(items) > 0).select(F.col(key).cast("long").alias("id"), F.col(items).alias("items"))
    blocks = max(1, -(-known.count() // BIT_BLOCK))

    def pack(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((len(rows), words), np.uint64)
        for i, one in enumerate(rows["items"]):
            for item in one:
                bits[i, place[item] // 64] |= np.uint64(1 << place[item] % 64)
        order = np.argsort(np.bitwise_count(bits).sum(axis=1), kind="stable")
        return pd.DataFrame({"block": [block[0]], "ids": [rows["id"].to_numpy(np.int64)[order].tobytes()], "bits": [bits[order].tobytes()]})

    packed = checkpointed(known.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).applyInPandas(pack, "block int, ids binary, bits binary"))
    side = lambda s: [F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("bits").alias(f"bits_{s}")]
    ahead = packed.select(*side("a"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("block_b"))
    met = ahead.join(packed.select(*side("b")), "block_b").repartition(min(blocks * (blocks + 1) // 2, 512), "block_a", "block_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                (a, x), (b, y) = ((np.frombuffer(one[f"ids_{s}"], np.int64), np.frombuffer(one[f"bits_{s}"], np.uint64).reshape(-1, words)) for s in "ab")
                m, n = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
                for size in np.unique(m):
                    lo, hi = np.searchsorted(n, [math.ceil(threshold * size - 1e-9), math.floor(size / threshold + 1e-9) + 1])
                    rows = np.flatnonzero(m == size)
                    least = np.ceil(threshold * (size + n[lo:hi]) / (1 + threshold) - 1e-9).astype(np.uint16)
                    for i in range(0, len(rows), 128):
                        own = rows[i : i + 128]
                        shared = np.zeros((len(own), hi - lo), np.uint16)
                        for w in range(words):
                            shared += np.bitwise_count(x[own, w][:, None] & y[None, lo:hi, w])
                        p, q = np.nonzero(shared >= least)
                        left, right, both = a[own[p]], b[lo + q], shared[p, q].astype(float)
                        score = both / (size + n[lo + q] - both)
                        keep = (score >= threshold - 1e-12) & ((left < right) if one["block_a"] == one["block_b"] else True)
                        if keep.any():
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)[keep]), pa.array(np.maximum(left, right)[keep]), pa.array(score[keep])], ["a", "b", "similarity"])

    kind = sets.schema[key].dataType.simpleString()
    return met.mapInArrow(compare, "a long, b long, similarity double").select(F.col("a").cast(kind).alias(f"{key}_a"), F.col("b").cast(kind).alias(f"{key}_b"), "similarity")


def coded(seq: Column) -> Column:
    """A sequence of up to 31 letters A, C, G, U as a number, two bits a letter, in the order of letters; null for any other."""
    return F.when(seq.rlike("^[ACGU]{1,31}$"), F.conv(F.translate(seq, "ACGU", "0123"), 4, 10).cast("long"))


def decoded(code: Column, length: Column) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), length, F.lit("0")), "0123", "ACGU")


def code_distance(a: Column, b: Column) -> Column:
    """Places in which two codes of one length differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _place_masks(n: Column, distance: int, most: int) -> Column:
    """Every choice of `distance` of n places (at most `most`) as a mask of their bits."""
    made = sorted(sum(3 << 2 * i for i in places_) for places_ in itertools.combinations(range(most), distance))
    return F.filter(F.array(*map(F.lit, made)).cast("array<long>"), lambda m: m < F.call_function("shiftleft", F.lit(1).cast("long"), 2 * n))


def snv_pairs(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Pairs of rows, in both directions, whose sequences of equal length differ in exactly one place.

    Each sequence is keyed by its length and itself with one place masked; rows that share a mask differ there only.
    Sequences of up to SHORT letters A, C, G, U are keyed by numbers, others by strings.
    """
    rows = checkpointed(df.select(key, seq).withColumn("n", F.length(seq)).withColumn("code", F.when(F.col("n") <= SHORT, coded(F.col(seq)))))
    parts = rows.where("code is not null").select(key, "n", "code", F.explode(places(F.col("n"))).alias("at"))
    shift = 2 * (F.col("n") - 1 - F.col("at"))
    bits = F.call_function("shiftleft", F.lit(3).cast("long"), shift)
    short = parts.select(key, "n", "at", F.col("code").bitwiseAND(F.bitwise_not(bits)).alias("mask"), F.call_function("shiftright", "code", shift).bitwiseAND(F.lit(3)).cast("int").alias("base"))

    def met(masked: DataFrame, apart: Column) -> DataFrame:
        a, b = (masked.select("n", "at", "mask", *(F.col(c).alias(f"{c}_{x}") for c in (key, "base", "known"))) for x in "ab")
        return a.join(b, ["n", "at", "mask"]).where(apart & (F.col("base_a") != F.col("base_b"))).select(f"{key}_a", f"{key}_b", F.col("at").alias("position"), "base_a", "base_b")

    letter = lambda x: F.substring(F.lit("ACGU"), F.col(x) + 1, F.lit(1)).alias(x)
    numbers = met(short.withColumn("known", F.lit(True)), F.lit(True)).select(f"{key}_a", f"{key}_b", "position", letter("base_a"), letter("base_b"))
    if rows.where("code is null").isEmpty():
        return numbers
    s = F.col(seq)
    spelled = rows.select(key, seq, "n", F.col("code").isNotNull().alias("known"), F.explode(places(F.col("n"))).alias("at"))
    masked = spelled.select(key, "n", "at", "known", F.concat(s.substr(F.lit(1), F.col("at")), F.lit("_"), s.substr(F.col("at") + 2, F.length(s))).alias("mask"), char(s, F.col("at")).alias("base"))
    return numbers.unionByName(met(masked, ~(F.col("known_a") & F.col("known_b"))))


def _masks(s: Column, distance: int, first: Column | int = 0) -> Column:
    """A sequence with every choice of `distance` places masked."""
    at = lambda i: F.filter(places(F.length(s)), lambda j: j >= i)
    hide = lambda x, i: F.overlay(x, F.lit("_"), i + 1, F.lit(1))
    if distance == 1:
        return F.transform(at(first), lambda i: hide(s, i))
    return F.flatten(F.transform(at(first), lambda i: F.transform(_masks(s, distance - 1, i + 1), lambda x: hide(x, i))))


def _coded_pairs(codes: DataFrame, seq: str, distance: int) -> DataFrame:
    """Pairs of distinct (n, code) within `distance` places: those that differ in exactly d places share the key that masks them."""
    found = None
    for d in range(1, distance + 1):
        masked = codes.where(F.col("n") >= d).select("n", "code", F.explode(_place_masks(F.col("n"), d, SHORT)).alias("mask")).withColumn("rest", F.col("code").bitwiseAND(F.bitwise_not("mask")))
        a, b = (masked.select("n", "mask", "rest", F.col("code").alias(s)) for s in "ab")
        met = a.join(b, ["n", "mask", "rest"]).where("a < b").where(code_distance(F.col("a"), F.col("b")) == d)
        pairs = met.select(decoded(F.col("a"), F.col("n")).alias(f"{seq}_a"), decoded(F.col("b"), F.col("n")).alias(f"{seq}_b"), F.lit(d).alias("distance"))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def hamming_pairs(df: DataFrame, seq: str, distance: int) -> DataFrame:
    """Pairs a < b of distinct sequences of equal length with 1 .. distance mismatches.

    The distinct sequences are written down once. Those of at most SHORT letters are keyed by themselves with every
    choice of places masked, so no key is common: as numbers of two bits a letter where all letters are A, C, G, U.
    Longer ones are cut into distance + 1 segments, of which two near sequences share at least one: the key is
    length, segment number and segment.
    """
    s, k = F.col(seq), distance + 1
    cut = lambda i: F.floor(F.length(s) * i / k).cast("int")
    every = checkpointed(df.select(seq).where(F.length(s) >= 1).distinct().select(seq, F.length(s).alias("n")).withColumn("code", F.when(F.col("n") <= SHORT, coded(s))))
    of_codes = _coded_pairs(every.where("code is not null"), seq, distance)
    plain = every.where("code is null").where(F.col("n") >= distance)
    if plain.isEmpty():
        return of_codes
    parts = F.array(*(F.struct(F.lit(i).alias("no"), s.substr(cut(i) + 1, cut(i + 1) - cut(i)).alias("part")) for i in range(k)))
    long = plain.where(F.col("n") > SHORT).select(seq, "n", F.explode(parts).alias("p")).select(seq, "n", "p.*")
    short = every.where(F.col("n") <= SHORT).select(seq, "n", F.lit(-1).alias("no"), F.explode(_masks(s, distance)).alias("part"))
    keyed = long.unionByName(short)
    a, b = (keyed.select("n", "no", "part", F.col(seq).alias(f"{seq}_{x}")) for x in "ab")
    met = a.join(b, ["n", "no", "part"]).where(F.col(f"{seq}_a") < F.col(f"{seq}_b")).select(f"{seq}_a", f"{seq}_b").distinct()
    d = hamming_distance(F.col(f"{seq}_a"), F.col(f"{seq}_b"))
    both_coded = coded(F.col(f"{seq}_a")).isNotNull() & coded(F.col(f"{seq}_b")).isNotNull() & (F.length(f"{seq}_a") <= SHORT)
    return met.where(~both_coded).withColumn("distance", d).where(F.col("distance").between(1, distance)).unionByName(of_codes)


def loop_pairs(plain: DataFrame, marked: DataFrame, distance: int) -> DataFrame:
    """Pairs of loops (pair_id, pair_type, loop_a, loop_b, distance): within plain, within marked, and each plain one with its marked form.

    marked has (orig, loop). Numbers run through all pairs, type by type, in the order of the loops.
    """
    same = lambda df, no, name: hamming_pairs(df, "loop", distance).select(F.lit(no).alias("__no"), F.lit(name).alias("pair_type"), "loop_a", "loop_b", "distance")
    cross = plain.join(marked.withColumnRenamed("loop", "m"), F.col("loop") == F.col("orig")).select(F.lit(3).alias("__no"), F.lit("M_vs_A").alias("pair_type"), F.col("loop").alias("loop_a"), F.col("m").alias("loop_b"), F.lit(1).alias("distance"))
    every = same(plain, 1, "A_vs_A").unionByName(same(marked.select("loop"), 2, "M_vs_M")).unionByName(cross).withColumn("__one", F.lit(1))
    numbered = running_total(every, ["__no", "loop_a", "loop_b"], "__one", "__at")
    prefix = F.when(F.col("__no") == 1, "AA").when(F.col("__no") == 2, "MM").otherwise("MA")
    return numbered.select(F.format_string("%s_%06d", prefix, F.col("__at")).alias("pair_id"), "pair_type", "loop_a", "loop_b", F.col("distance").cast("long").alias("distance"))


def stack_members(pairs: DataFrame, a: list[str], b: list[str], names: list[str], more: list[str]) -> DataFrame:
    """A and B rows of a pair table as one table of single objects."""
    sides = (pairs.select(*(F.col(c).alias(n) for c, n in zip(cols, names, strict=True)), *more) for cols in (a, b))
    return reduce(lambda x, y: x.unionByName(y), sides)


def reference_pairs(df: DataFrame, group: list[str], score: str, key: str, seq: str, most: int = 5) -> DataFrame:
    """The best row of each group against every other row of equal length that differs in 1 .. most places."""
    best = df.groupBy(*group).agg(F.max_by(F.struct(key, seq, score), F.struct(F.col(score), -F.col(key))).alias("r"), F.count("*").alias("n")).where("n >= 2")
    ref = best.select(*group, *(F.col(f"r.{c}").alias(f"ref_{c}") for c in (key, seq, score)))
    one, other = F.col(f"ref_{seq}"), F.col(seq)
    unlike = lambda i: F.when(one.substr(i, 1) != other.substr(i, 1), 1).otherwise(0)
    short = (F.length(one) == F.length(other)) & (F.length(one) <= SHORT)  # spelled out, which is compiled; behind the end both are empty
    d = F.when(short, reduce(lambda x, y: x + y, map(unlike, range(1, SHORT + 1)))).otherwise(hamming_distance(one, other))
    return df.join(ref, group).where(F.col(key) != F.col(f"ref_{key}")).withColumn("n_changes", d).where(F.col("n_changes").between(1, most)).withColumn("delta", F.col(score) - F.col(f"ref_{score}"))
