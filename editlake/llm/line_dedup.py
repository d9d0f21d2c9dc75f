"""Line deduplication with a suffix array over line ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.llm.common import WORD, checkpointed, text_of

#: A repeated run is deleted if it has this many lines, or fewer lines with this many words: single short lines ("Contents", a
#: date, an empty line) recur in texts that are no copies of each other.
MIN_LINES, MIN_WORDS = 3, 20
NO_ID = -(1 << 63)
#: A round of ranks makes five doublings at once: each counts 32 times as many lines as the one before.
STEP = 32
SUFFIX = ["id", "k", "no"]


def _merged(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A sort-merge join: rounds that each broadcast a small side would fill the driver's memory with their tables."""
    return left.join(right.hint("merge"), on)


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-sorted by `order` and then by suffix, so that one value may fill many partitions; with `at` and `part`."""
    keys = [*order, *SUFFIX]
    placed = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    return placed.withColumn("part", F.shiftright("at", 33))


def _running_start(rows: DataFrame, opens: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `name`: the `pos` of the last row at or before each one (of the same `by`) for which `opens` holds, across partitions."""
    upto = Window.partitionBy("part", *by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__open", F.when(opens, F.col("pos"))).withColumn("__local", F.max("__open").over(upto))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = marked.groupBy("part", *by).agg(F.max("__open").alias("__last"))
    carry = carry.select(F.col("part").alias("__part"), *(F.col(c).alias(f"__by_{c}") for c in by), F.max("__last").over(earlier).alias("__carry"))
    same = F.col("part") == F.col("__part")
    for c in by:
        same = same & (F.col(c) == F.col(f"__by_{c}"))
    return marked.join(F.broadcast(carry), same).withColumn(name, F.coalesce("__local", "__carry")).select(*rows.columns, name)


def with_places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted rows (`in_order`) with pos, their place from 0, and before, the keys and suffix of the row before each.

    What is broadcast has one row for each partition.
    """
    row = F.struct(*keys, *SUFFIX)
    w, parts = Window.partitionBy("part").orderBy("at"), Window.orderBy("part")
    edges = rows.groupBy("part").agg(F.count("*").alias("n"), F.max_by(row, "at").alias("last"))
    edges = edges.select(
        F.col("part").alias("__part"),
        F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
        F.lag("last").over(parts).alias("__last"),
    )
    joined = rows.join(F.broadcast(edges), F.col("part") == F.col("__part"))
    placed = joined.withColumn("pos", F.col("__offset") + F.row_number().over(w) - 1)
    return placed.withColumn("before", F.coalesce(F.lag(row).over(w), F.col("__last"))).drop("__part", "__offset", "__last")


def _keys(columns: list[str]) -> list[str]:
    """The keys of a suffix, one for each round."""
    return [f"key{j}" for j in range(sum(c.startswith("key") for c in columns))]


def _suffixes(stretches: DataFrame, rounds: int) -> DataFrame:
    """One row for each line of a stretch: SUFFIX, start, rest (lines to the end of the stretch), q, line, key0, key1, ...

    Key 0 is the next STEP lines, key j the ranks of round j - 1 there, STEP^j lines further on, and so on, STEP in all.
    """
    each = stretches.select("id", "k", "start", "n", "ranks0", *(f"ranks{j}" for j in range(1, rounds)), F.posexplode("qs").alias("i", "q"))
    keys = [F.slice("ranks0", F.col("i") + 1, STEP).alias("key0")]
    for j in range(1, rounds):
        ahead = F.array(*(F.get(f"ranks{j}", F.col("i") + m * STEP**j) for m in range(STEP)))
        keys.append(F.slice(ahead, F.lit(1), F.least(F.lit(STEP), F.floor((F.col("n") - F.col("i") - 1) / STEP**j).cast("int") + 1)).alias(f"key{j}"))
    return each.select("id", "k", (F.col("start") + F.col("i")).alias("no"), "start", (F.col("n") - F.col("i")).alias("rest"), "q", F.get("ranks0", "i").alias("line"), *keys)


def _stretches(lines: DataFrame) -> DataFrame:
    """lines (id, k, no, q, a, b) -> (id, k, start, n, ranks0, qs): the longest stretches of lines that each occur elsewhere too.

    A line that occurs once is like no other and ends what two suffixes share, as the end of a text does. ranks0 are the
    numbers of the lines. Wholly equal rows of documents are one.
    """
    many = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b", F.monotonically_increasing_id().alias("line"))
    known = _merged(lines, checkpointed(many), ["a", "b"]).select(*SUFFIX, "q", "line")
    gap = F.col("no") - F.dense_rank().over(Window.partitionBy("id", "k").orderBy("no"))
    cells = F.sort_array(F.collect_set(F.struct("no", "line", "q")))
    grouped = known.withColumn("gap", gap).groupBy("id", "k", "gap").agg(cells.alias("cells"))
    return checkpointed(grouped.select("id", "k", F.col("cells")[0]["no"].alias("start"), F.size("cells").alias("n"), F.col("cells.line").alias("ranks0"), F.col("cells.q").alias("qs")))


def suffix_array(lines: DataFrame) -> DataFrame:
    """lines (id, k, no, q, a, b) -> the suffixes whose first line occurs elsewhere too, with the keys that order them.

    (a, b) is a line's 128-bit id. Prefix doubling, STEP-fold in a round: in the first, the suffixes of a stretch
    (`_stretches`) are ranked by their next STEP lines; each further round takes the ranks of the suffixes once, twice, ...
    as many lines further on from the array of ranks of the stretch, and ranks by these. Only distinct keys are sorted, so
    a frequent line is one of them. A stretch leaves when its length is counted, and rounds go on until none is left.
    """
    open_, done, rounds = _stretches(lines), [], 1
    while True:
        done.append(_suffixes(open_.where(F.col("n") <= STEP**rounds), rounds))
        open_ = open_.where(F.col("n") > STEP**rounds)
        if open_.isEmpty():
            break
        key = f"key{rounds - 1}"
        each = _suffixes(open_, rounds).select("id", "k", "start", "no", key)
        ranks = checkpointed(each.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("rank", F.monotonically_increasing_id()))
        ranked = _merged(each, ranks, [key]).groupBy("id", "k", "start").agg(F.sort_array(F.collect_list(F.struct("no", "rank"))).alias("x"))
        open_ = checkpointed(_merged(open_, ranked.select("id", "k", "start", F.col("x.rank").alias(f"ranks{rounds}")), ["id", "k", "start"]))
        rounds += 1
    every = done[-1]
    for rows in done[:-1]:
        every = every.unionByName(rows, allowMissingColumns=True)
    return every.drop("start")


def _alike(a: Column, b: Column) -> Column:
    """Elements that two arrays begin with in common."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(other == 0, F.size(a)).otherwise(other - 1)


def with_lcp(array: DataFrame) -> DataFrame:
    """The suffix array in order: pos and lcp, the lines that a suffix and the one before it both begin with.

    The last of the keys that both have, those before it being equal, tells the lines in common up to a block that
    differs; its rank leads to the key by which that block was ranked, and so on down to single lines.
    """
    keys = _keys(array.columns)
    ordered = in_order(array, ["line", *keys])
    placed = with_places(ordered, ["rest", *keys])
    lcp, level, a, b = _alike(F.col("key0"), F.col("before.key0")), F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for j in range(1, len(keys)):
        mine, other = F.col(keys[j]), F.col(f"before.{keys[j]}")
        deeper = mine.isNotNull() & other.isNotNull() & (F.col(keys[j - 1]) == F.col(f"before.{keys[j - 1]}"))
        same = _alike(mine, other)
        differ = deeper & (same < F.least(F.size(mine), F.size(other)))
        lcp = F.when(differ, same * STEP**j).when(deeper, F.least("rest", "before.rest")).otherwise(lcp)
        level = F.when(differ, F.lit(j)).when(~deeper, level)
        a, b = F.when(differ, F.get(mine, same)).when(~deeper, a), F.when(differ, F.get(other, same)).when(~deeper, b)
    known = placed.select(*SUFFIX, "rest", "q", "at", "part", "pos", F.coalesce(lcp, F.lit(0)).alias("lcp"), level.alias("level"), a.alias("a"), b.alias("b"))
    for j in range(len(keys) - 1, 0, -1):
        known = checkpointed(known)
        block = ordered.where(F.col(keys[j]).isNotNull()).groupBy(F.col(keys[j])[0].alias("rank")).agg(F.min(F.struct(F.least("rest", F.lit(STEP**j)).alias("span"), F.col(keys[j - 1]).alias("key"))).alias("x"))
        block = block.select("rank", "x.*")
        first = block.select(F.col("rank").alias("a"), F.col("span").alias("a_span"), F.col("key").alias("a_key"))
        second = block.select(F.col("rank").alias("b"), F.col("span").alias("b_span"), F.col("key").alias("b_key"))
        pairs = _merged(_merged(known.where(F.col("level") == j), first, ["a"]), second, ["b"]).withColumn("same", _alike(F.col("a_key"), F.col("b_key")))
        differ = F.col("same") < F.least(F.size("a_key"), F.size("b_key"))
        more = F.when(differ, F.col("same") * STEP ** (j - 1)).otherwise(F.least("a_span", "b_span"))
        told = pairs.withColumns({"lcp": F.col("lcp") + more, "level": F.when(differ & F.lit(j > 1), F.lit(j - 1)), "a": F.when(differ, F.get("a_key", "same")), "b": F.when(differ, F.get("b_key", "same"))})
        known = known.where(F.coalesce(F.col("level"), F.lit(0)) != j).unionByName(told.select(*known.columns))
    return known.drop("level", "a", "b")


def repeated_runs(array: DataFrame, least: int = MIN_LINES) -> DataFrame:
    """The suffix array with lcp -> (id, k, start, n_lines, first_id, first_k, first_start): the runs that are later copies.

    For each depth from q, the fewest lines that make a run worth deleting, to `least`, suffixes are an interval where
    each shares at least so many lines with the one before. The first of an interval stays; the others are later
    copies of these lines, and neighbours whose firsts are neighbours too are one run. An interval meets its first copy
    by partition of the sorted array, so a line that is everywhere is not one group.
    """
    most = F.least(F.lit(least), F.col("rest"))
    deep = array.where(F.col("q") <= most).withColumn("depth", F.explode(F.sequence("q", most)))
    opened = checkpointed(_running_start(deep, F.col("lcp") < F.col("depth"), "interval", ("depth",)).select(*SUFFIX, "depth", "part", "interval"))
    parts = opened.groupBy("depth", "interval", "part").agg(F.min(F.struct(*SUFFIX)).alias("least"))
    firsts = _merged(parts, parts.groupBy("depth", "interval").agg(F.min("least").alias("first")), ["depth", "interval"]).select("depth", "interval", "part", "first")
    later = _merged(opened, firsts, ["depth", "interval", "part"]).where(F.struct(*SUFFIX) > F.col("first"))
    pointed = later.select(*SUFFIX, "depth", F.col("first.id").alias("first_id"), F.col("first.k").alias("first_k"), (F.col("no") - F.col("first.no")).alias("shift"))
    pair = ["id", "k", "first_id", "first_k", "shift", "depth"]
    islands = pointed.withColumn("island", F.col("no") - F.row_number().over(Window.partitionBy(*pair).orderBy("no")))
    runs = islands.groupBy(*pair, "island").agg(F.min("no").alias("start"), (F.max("no") - F.min("no") + F.col("depth")).alias("n_lines"))
    return runs.select("id", "k", "start", "n_lines", "first_id", "first_k", (F.col("start") - F.col("shift")).alias("first_start"))


def _line_counts() -> Column:
    """The number of words of each of `lines`."""
    return F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD)))


def _enough(i: Column, least: int, words: int) -> Column:
    """Of `lines` with their `counts`: how many from line i on make a run worth deleting, null where the text ends before."""
    found, total = F.lit(None).cast("int"), F.lit(0)
    for m in range(1, least + 1):
        total = total + F.coalesce(F.get("counts", i + (m - 1)), F.lit(0))
        found = F.coalesce(found, F.when((i + m <= F.size("lines")) & ((total >= words) | F.lit(m == least)), F.lit(m)))
    return found


def line_ids(docs: DataFrame, least: int = MIN_LINES, words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents as (id, k, text), k a hash of the text, and their lines as (id, k, no, q, a, b).

    q is the number of lines from there that make a run worth deleting: the fewest with `words` words, `least` at most,
    null where the text ends before.
    """
    given = docs.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(text_col)).alias("k"), text_of(text_col).alias("text"))
    split = given.where("text != ''").select("id", "k", F.split("text", "\n").alias("lines")).withColumn("counts", _line_counts())
    each = F.transform("lines", lambda x, i: F.struct(i.alias("no"), _enough(i, least, words).alias("q"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b")))
    return given, split.select("id", "k", F.explode(each).alias("x")).select("id", "k", "x.*")


def line_dedup(docs: DataFrame, least: int = MIN_LINES, words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deletes later copies of every run of lines that occurs more than once and has `least` lines or `words` words.

    Of a maximal repeated run the first copy stays (smallest id, then line). Lines are what stands between line feeds,
    compared as they are by 128-bit hashes; empty lines count. Runs are found in the suffix array of all lines, from its
    longest common prefixes.

    Returns id, n_lines, n_removed, kept_text (kept lines joined by line feeds). Null and empty texts have no lines.
    Ids are read as whole numbers, others as null. Null ids sort before others; rows with one id but different texts
    are documents of their own; of wholly equal rows all but one count as copies, and lose the lines of their runs. No
    rows in, none out; other columns are ignored.
    """
    given, lines = line_ids(docs, least, words, id_col, text_col)
    lines = checkpointed(lines)
    runs = repeated_runs(with_lcp(suffix_array(lines)), least)
    gone = runs.groupBy("id", "k").agg(F.collect_list(F.struct("start", "n_lines")).alias("runs"))
    copies = given.withColumn("copy", F.row_number().over(Window.partitionBy("id", "k").orderBy("k")))
    split = copies.join(gone, ["id", "k"], "left").withColumn("lines", F.when(F.col("text") != "", F.split("text", "\n")).otherwise(F.array().cast("array<string>")))
    split = split.withColumn("counts", F.when(F.col("copy") > 1, _line_counts()))
    n = F.size("lines")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.transform(every, lambda i: F.struct(i.alias("start"), F.when(_enough(i, least, words).isNotNull(), F.least(F.lit(least), n - i)).alias("n_lines")))
    starts = F.filter(whole, lambda r: r.n_lines.isNotNull())
    mine = F.when(F.col("copy") > 1, starts).otherwise(F.col("runs"))
    removed = F.flatten(F.transform(mine, lambda r: F.sequence(r.start, r.start + r.n_lines - 1)))
    left = F.when(mine.isNull(), every).otherwise(F.array_except(every, removed))
    return split.withColumn("left", left).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        n.cast("long").alias("n_lines"),
        (n - F.size("left")).cast("long").alias("n_removed"),
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )
