"""Substring deduplication by super-k-mer partitioning of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.llm.common import checkpointed, text_of
from editlake.llm.wordbatch import WINDOWS, Words, chunks, mixed, rolled

WINDOW = 20
#: Words of a minimiser; where the bucket of a word just below FREQUENT would exceed LARGE bytes, LONG words, which make buckets so much smaller.
MINIMISER, LONG, LARGE = 1, 6, 128 << 20
#: A minimiser with at least this share of all positions is taken only where a window has no rarer one. At most 1 / share can have it.
FREQUENT = 1 / 2000
#: Bytes of packed strings that one bucket group is to hold, and a task that reads such groups; packed strings have about PACKED times the bytes of the texts.
GROUP_BYTES, TASK_BYTES, PACKED = 8 << 20, 64 << 20, 3
#: Bytes of text whose packed strings a task sends together: more make larger blocks for a group, which compress better.
CHUNK, LEVEL = 4 << 20, 6
#: Packed strings that a task remembers, to send repeats of its own no further.
REMEMBERED = 50_000
NO_ID = -(1 << 63)


def _minimisers(words: Words, size: int) -> np.ndarray:
    """A hash for the words that start at each place (those over the end of a text are not used)."""
    h = words.hashes()
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - size + 1 + i]
    return mixed(out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[list]:
    """The columns of a few rows at a time, as lists; the last column, a text, as bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            some = batch.slice(i, rows)
            yield [*(c.to_pylist() for c in some.columns[:-1]), some.columns[-1].cast(pa.binary()).to_pylist()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for columns in _slices(batches):
        yield from zip(*columns, strict=True)


def _count_minimisers(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those with at least half the share within a chunk; at most 2 / FREQUENT rows a chunk, and one for the totals."""
        for rows in chunks(_rows(batches), lambda r: len(r[0])):
            words = Words([r[0] for r in rows])
            found, n = np.unique(_minimisers(words, size), return_counts=True)
            often = n >= max(8, n.sum() * FREQUENT / 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(words.start))), pa.array(np.append(np.zeros(often.sum(), np.int64), len(words.buffer)))], ["minimiser", "n", "words", "bytes"])

    return count


def _lowest(rank: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` neighbours, by smallest ones of ever wider spans."""
    lowest, width = rank, 1
    while width < span:
        step = min(width, span - width)
        lowest, width = np.minimum(lowest[: len(lowest) - step], lowest[step:]), width + step
    return lowest


def _super_kmers(words: Words, window: int, size: int, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first word and number of windows of each maximal run of windows with one bucket key, and the key.

    The key is the smallest minimiser. Windows that hold frequent ones only would all meet in few buckets: their key is
    the smallest minimiser together with the smallest one of LONG words, which equal windows share as well.
    """
    none = np.zeros(0, np.int64)
    if len(words.start) < window:
        return none, none, none, none.view(np.uint64)
    rank = _minimisers(words, size)
    often = frequent[np.minimum(np.searchsorted(frequent, rank), len(frequent) - 1)] == rank if len(frequent) else np.zeros(len(rank), bool)
    rank = np.where(often, rank | np.uint64(1 << 63), rank >> np.uint64(1))
    lowest = _lowest(rank, window - size + 1)
    text = words.text_of_word()
    whole = text[: len(text) - window + 1] == text[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none.view(np.uint64)
    low = lowest[at]
    hot = low >> np.uint64(63) == 1
    if hot.any():
        long = min(LONG, window)
        second = _lowest(_minimisers(words, long), window - long + 1)[at]
        low = np.where(hot, mixed(low ^ mixed(second)), low)
    opens = np.concatenate([[True], (np.diff(at) != 1) | (low[1:] != low[:-1]) | (np.diff(text[at]) != 0)])
    begin = np.flatnonzero(opens)
    return text[at[begin]], at[begin], np.diff(np.append(begin, len(at))), low[begin]


def _pack(rows: list[tuple]) -> bytes:
    """Rows (id, hash, start, packed string) as one compressed block."""
    ids, ks, starts, strings = zip(*rows, strict=True)
    parts = [np.array(ids, np.int64), np.array(ks, np.int64), np.array(starts, np.int32), np.array([len(s) for s in strings], np.int32)]
    raw = b"".join([np.array([len(rows)], np.int64).tobytes(), *(p.tobytes() for p in parts), *strings])
    return np.array([len(raw)], np.int64).tobytes() + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def _unpack(block: bytes) -> list[tuple]:
    raw = pa.decompress(block[8:], decompressed_size=int(np.frombuffer(block[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    at, out = 8, []
    for kind in (np.int64, np.int64, np.int32, np.int32):
        width = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw[at : at + width], kind))
        at += width
    ends = at + np.cumsum(out[3])
    strings = [raw[s:e] for s, e in zip((ends - out[3]).tolist(), ends.tolist(), strict=True)]
    return list(zip(out[0].tolist(), out[1].tolist(), out[2].tolist(), strings, strict=True))


def _emit(groups: np.ndarray, blocks: list, spans: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Blocks for their groups, and spans of removed words, which need no group and are dealt out at random."""
    ids, ks, begin, end = ([x[i] for x in spans] for i in range(4))
    n, m = len(blocks), len(spans)
    if n or m:
        yield pa.RecordBatch.from_arrays([pa.array([*groups, *((hash((i, b)) >> 3) for i, b in zip(ids, begin, strict=True))], pa.int64()), pa.array([*blocks, *[None] * m], pa.binary()), pa.array([*[None] * n, *ids], pa.int64()), pa.array([*[None] * n, *ks], pa.int64()), pa.array([*[None] * n, *begin], pa.int32()), pa.array([*[None] * n, *end], pa.int32())], ["group", "block", "id", "k", "begin", "end"])


_ROW = "group long, block binary, id long, k long, begin int, end int"


def _send(window: int, size: int, frequent: np.ndarray, groups: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for rows in chunks(_rows(batches), lambda r: len(r[2]), CHUNK):
            words = Words([r[2] for r in rows])
            text, begin, n, low = _super_kmers(words, window, size, frequent)
            held: dict[int, list] = {}
            spans, flat = [], words.buffer.tobytes()
            starts, ends = words.start[begin].tolist(), words.end[begin + n + (window - 2)].tolist() if len(begin) else []
            local = (begin - words.first[text]).tolist()
            group = (mixed(low) % np.uint64(groups)).tolist()
            for t, s, e, at, g, m in zip(text.tolist(), starts, ends, local, group, n.tolist(), strict=True):
                string, mine = flat[s:e], (rows[t][0], rows[t][1], at)
                if (first := known.get(string)) is not None and first <= mine:  # each of its windows starts earlier elsewhere
                    if first < mine:
                        spans.append((mine[0], mine[1], at, at + m + window - 1))
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known[string] = mine
                held.setdefault(g, []).append((*mine, string))
            yield from _emit(list(held), [_pack(x) for x in held.values()], spans)

    return send


def _repeats(rows: list[tuple], window: int) -> list[tuple]:
    """Spans of words under windows that start earlier: windows are sorted, and compared with the first of their kind."""
    rows = sorted(rows, key=lambda r: r[:3])
    words = Words([r[3] for r in rows])
    text = words.text_of_word()
    at = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
    key = rolled(words.hashes(), at, at + window, WINDOWS)
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_at = key[order], at[order]
    opens = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    first = sorted_at[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    later, first = sorted_at[~opens], first[~opens]
    order = np.argsort(later)
    later, first = later[order], first[order]
    if not len(later):
        return []
    flat, out = words.buffer.tobytes(), []
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(later) != 1) | (np.diff(first) != 1)]))
    lengths = np.diff(np.append(cut, len(later)))

    def string(a: int, n: int) -> bytes:
        return flat[words.start[a] : words.end[a + n + window - 2]]

    for a, b, n in zip(later[cut].tolist(), first[cut].tolist(), lengths.tolist(), strict=True):
        one, two = rows[text[a]], rows[text[b]]
        begin = one[2] + a - int(words.first[text[a]])
        if string(a, n) != string(b, n):  # two windows with one hash: look at all of them
            return _repeats_by_string(rows, window)
        if (one[0], one[1], begin) != (two[0], two[1], two[2] + b - int(words.first[text[b]])):
            out.append((one[0], one[1], begin, begin + n + window - 1))
    return out


def _repeats_by_string(rows: list[tuple], window: int) -> list[tuple]:
    seen, out = {}, []
    for i, k, start, string in rows:
        parts = string.split()
        for j in range(len(parts) - window + 1):
            mine = (i, k, start + j)
            if seen.setdefault(tuple(parts[j : j + window]), mine) < mine:
                out.append((*mine, start + j + window))
    return out


def _count(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after the other; a group's blocks are held together."""
        now, rows, spans = None, [], []
        for batch in batches:
            groups, blocks, *rest = (c.to_pylist() for c in batch.columns)
            for g, block, i, k, begin, end in zip(groups, blocks, *rest, strict=True):
                if block is None:
                    spans.append((i, k, begin, end))
                    continue
                if g != now and rows:
                    spans += _repeats(rows, window)
                    rows = []
                now = g
                rows += _unpack(block)
            if len(spans) > 10_000:
                yield from _emit(np.zeros(0), [], spans)
                spans = []
        if rows:
            spans += _repeats(rows, window)
        yield from _emit(np.zeros(0), [], spans)

    return count


def _keep(window: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, copies, spans, texts in _slices(batches):
            counts, removed, kept = [], [], []
            for copy, found, text in zip(copies, spans, texts, strict=True):
                words = text.split()
                counts.append(len(words))
                if copy > 1 and len(words) >= window:
                    found = [{"begin": 0, "end": len(words)}]
                left, at = [], 0
                for s in sorted((x["begin"], x["end"]) for x in found or ()):
                    left += words[at : s[0]] if s[0] > at else []
                    at = max(at, s[1])
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return keep


def substring_dedup(docs: DataFrame, window: int = WINDOW, minimiser: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word under a window of `window` words whose word sequence starts earlier (smaller id, or same text, earlier).

    Windows are ordered into buckets by their minimiser, the smallest hash of `minimiser` words in them; a maximal run of
    windows with one minimiser travels as one packed string. A first pass counts minimisers: those with FREQUENT of all
    positions (at most 1 / FREQUENT) rank last, so that a common phrase does not draw every window around it into its
    bucket, and windows with no other are dealt by a second, longer minimiser too. Minimisers get longer where the bytes
    of all texts would make buckets too large (`minimiser` None), and the number of tasks follows from the bytes. A task
    sends a packed string that it has sent before no further: all windows of a later one start earlier elsewhere. In
    its bucket group the windows of the packed strings are sorted by hash and compared as strings, so results are
    exact; spans to be removed then go back to their documents.

    Returns id, n_words, n_removed, kept_text (kept words joined by one space). Null and empty texts have no words; texts
    shorter than a window stay. Ids are read as whole numbers, others as null. Null ids sort before others; rows with
    one id but different texts are documents of their own, ordered by a 64-bit hash of the text; of wholly equal rows
    all but one count as repeats. No rows in, none out; other columns are ignored.
    """
    given = docs.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(text_col)).alias("k"), text_of(text_col).alias("text"))
    size = minimiser or min(MINIMISER, window)
    counted = checkpointed(given.select("text").mapInArrow(_count_minimisers(size), "minimiser long, n long, words long, bytes long").groupBy("minimiser").agg(*(F.sum(c).alias(c) for c in ("n", "words", "bytes"))))
    total = counted.agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes")).first()
    packed = PACKED * (total["bytes"] or 0)
    frequent = np.zeros(0, np.uint64)
    if minimiser is None and packed * FREQUENT > LARGE:
        size = min(LONG, window)
    else:
        often = counted.where(F.col("n") >= F.lit(max(8.0, (total["words"] or 0) * FREQUENT))).select("minimiser").collect()
        frequent = np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64))
    groups, tasks = max(256, packed // GROUP_BYTES), max(docs.sparkSession.sparkContext.defaultParallelism, packed // TASK_BYTES)
    sent = given.mapInArrow(_send(window, size, frequent, groups), _ROW)
    spans = sent.repartition(int(tasks), "group").sortWithinPartitions("group").mapInArrow(_count(window), _ROW)
    spans = spans.groupBy("id", "k").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    copies = given.withColumn("copy", F.row_number().over(Window.partitionBy("id", "k").orderBy("k")))
    kept = copies.join(spans, ["id", "k"], "left").select("id", "copy", "spans", "text").mapInArrow(_keep(window), "id long, n_words long, n_removed long, kept_text string")
    return kept.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_text")
