"""Removal of long byte strings that occur more than once.

A window is a string of `length` bytes. Its anchor is the leftmost of its `gram`-byte pieces
with the smallest hash, so equal windows have equal anchors at the same place. Windows
that follow one another mostly share an anchor; such a run is one row, not one per byte.

1. Runs whose anchor occurs once hold no repeated window. A first pass counts anchors.
2. Of the others, runs that are equal as a whole are settled by counting, too.
3. The rest are few: runs at the ends of repeated passages. Runs with one anchor meet,
   their windows are put into suffix order, and the longest-previous-factor array,
   from the previous and next smaller positions in that order, tells the windows that
   occur earlier; the same from the other side tells those that occur later.
4. Where many different runs have one anchor, they are cut into blocks of windows at
   fixed distances from the anchor; the bytes that all windows of a block share take the
   anchor's place, and steps 2 and 3 begin again. Blocks that still crowd are cut into single
   windows, which counting settles. So no key can make a large task.

Filters of a bounded size, sent to all tasks, spare shuffles of rows that cannot matter. A
false answer of a filter costs work, never a result. Equality in steps 1, 2 and 4 is that of
two 64-bit hashes; in step 3 it is that of the bytes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import pin, slices, text_or_empty

LENGTH, GRAM = 200, 100
#: Bytes of a long text that are looked at together; runs that it cuts are two runs.
CHUNK = 1 << 20
#: Groups of more different runs than this are cut into blocks of so many windows, then into windows.
GROUP_RUNS, BLOCK = 512, 16
FILTER_BITS = 1 << 27

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(3).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


class Hasher:
    """Hashes of all substrings of a byte array from one pass of sums."""

    up: np.ndarray = np.ones(1, np.uint64)
    down: np.ndarray = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hasher.up) < n:
            Hasher.up, Hasher.down = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTES[data] * Hasher.up[: n - 1], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * Hasher.down[begin]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its leftmost smallest one."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    block = padded.reshape(rows, width)
    place = np.arange(rows * width).reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1)
    new = np.ones_like(block, bool)
    new[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1]
    new[:, -1] = True
    new[:, :-1] = block[:, :-1] <= back[:, 1:]
    back_at = np.minimum.accumulate(np.where(new, place, rows * width)[:, ::-1], axis=1)[:, ::-1]
    begin = np.arange(n - width + 1)
    left, right = back.ravel()[begin], ahead.ravel()[begin + width - 1]
    return np.where(left <= right, back_at.ravel()[begin], ahead_at.ravel()[begin + width - 1])


@dataclass
class Runs:
    """Runs of windows in one byte array: `first` and `last` window and anchor `at` are
    places in it; `key` and `place` name the anchor in its text, `h` is its hash and `f`
    that of the whole run with its shape."""

    key: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    h: np.ndarray
    f: np.ndarray

    def where(self) -> np.ndarray:
        """Place and reach of the run in one number, in the order of places."""
        return self.place << 16 | (self.at - self.first) << 8 | (self.at - self.last)

    def chosen(self, keep: np.ndarray) -> Runs:
        return Runs(*(getattr(self, name)[keep] for name in self.__dataclass_fields__))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _whole(hasher: Hasher, first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        shape = ((at - first) << 8 | (last - first)).astype(np.uint64) * np.uint64(BASE)
    return _mixed(hasher.spans(first, last + length) ^ shape).view(np.int64)


def runs_of(hasher: Hasher, data: np.ndarray, keys: np.ndarray, offsets: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> Runs:
    """The runs of texts that lie one after another in `data`."""
    places = np.arange(len(data) - gram + 1)
    grams = hasher.spans(places, places + gram)
    anchor = leftmost_minima(grams, length - gram + 1)
    text = np.repeat(np.arange(len(begins)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= (begins + sizes)[text]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | start[1:]
    last = np.flatnonzero(stop)
    at, own = anchor[first], text[first]
    place = at - begins[own] + offsets[own]
    return Runs(keys[own], place, first, last, at, grams[at].view(np.int64), _whole(hasher, first, last, at, length))


def blocks_of(hasher: Hasher, runs: Runs, length: int, size: int) -> Runs:
    """The runs cut into blocks of `size` windows, by the distance of a window from its
    anchor; the hash of what all windows of a block share is added to the anchor's."""
    low, high = (runs.at - runs.last) // size, (runs.at - runs.first) // size
    each = high - low + 1
    row = np.repeat(np.arange(len(each)), each)
    block = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    cut = runs.chosen(row)
    near, far = block * size, block * size + size - 1
    first = np.maximum(cut.first, cut.at - far)
    last = np.minimum(cut.last, cut.at - near)
    shared = hasher.spans(cut.at - near, cut.at - far + length)
    with np.errstate(over="ignore"):
        h = _mixed(shared ^ cut.h.view(np.uint64) ^ (block.astype(np.uint64) * np.uint64(BASE)))
    return Runs(cut.key, cut.place, first, last, cut.at, h.view(np.int64), _whole(hasher, first, last, cut.at, length))


def xxh64_long(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 8-byte integers, as the engine's own function on bigint columns."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        k = value.astype(np.int64).view(np.uint64) * p2
        k = ((k << np.uint64(31)) | (k >> np.uint64(33))) * p1
        x = (np.asarray(seed, np.uint64) + p5 + np.uint64(8)) ^ k
        x = ((x << np.uint64(27)) | (x >> np.uint64(37))) * p1 + p4
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))


class Filter:
    """A Bloom filter of a bounded number of bits with two hash functions."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, values: Column, rows: DataFrame, most_bits: int) -> Filter:
        """Holds a bigint column of any number of rows in 16 to 32 bits each, but never more
        than `most_bits` in all; what comes to the driver is at most one row per 64 bits."""
        bits = min(most_bits, max(1 << 16, 1 << (16 * rows.count()).bit_length()))
        at = F.explode(F.array(F.pmod(values, F.lit(bits)), F.pmod(F.xxhash64(values), F.lit(bits))))
        mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
        words = rows.select(at.alias("bit")).select(F.expr("bit >> 6").alias("word"), mask.alias("mask"))
        got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        full = np.zeros(bits // 64, np.int64)
        full[got.column("word").to_numpy()] = got.column("mask").to_numpy()
        return cls(full.view(np.uint64))

    def has(self, values: np.ndarray) -> np.ndarray:
        bits = np.int64(len(self.words) * 64)
        signed = values.view(np.int64)
        found = np.ones(len(values), bool)
        for at in (np.mod(signed, bits), np.mod(xxh64_long(signed, 42).view(np.int64), bits)):
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def _segments(batches: Iterator[pa.RecordBatch], length: int):
    """Texts of batches as one byte array at a time: keys, offsets in their text, data,
    begins and sizes; a text longer than CHUNK in pieces that overlap by length - 1."""
    keys, offsets, parts, held = [], [], [], 0

    def out():
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        return np.array(keys, np.int64), np.array(offsets, np.int64), data, np.cumsum(sizes) - sizes, sizes

    for whole in batches:
        for batch in slices([whole], "text", CHUNK):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                data = text.as_buffer()
                for begin in range(0, max(1, data.size - length + 1), CHUNK):
                    part = data[begin : begin + CHUNK + length - 1] if data.size > CHUNK else data
                    if part.size < length:
                        continue
                    keys.append(key)
                    offsets.append(begin)
                    parts.append(part.to_pybytes())
                    held += part.size
                    if held > CHUNK:
                        yield out()
                        keys, offsets, parts, held = [], [], [], 0
    if parts:
        yield out()


def _run_rows(docs: DataFrame, length: int, gram: int, schema: str, make) -> DataFrame:
    """A pass over texts; `make` turns the runs of some texts into columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, data, begins, sizes in _segments(batches, length):
            hasher = Hasher(data)
            columns = make(hasher, data, runs_of(hasher, data, keys, offsets, begins, sizes, length, gram))
            if len(columns[0]):
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(run, schema)


def longest_previous_factors(position: list[int], common: list[int]) -> list[int]:
    """By rank in suffix order: the longest match with a suffix at an earlier position.

    `position[r]` is the position of the suffix of rank r, `common[r]` the length of the
    prefix it shares with the one before it. The previous and the next suffix in order with a
    smaller position are found with a stack; the longest match is with one of the two.
    """
    n = len(position)
    best = [0] * n
    stack: list[tuple[int, int]] = []
    for r in range(n + 1):
        shared = common[r] if 0 < r < n else 0
        here = position[r] if r < n else -1
        while stack:
            top, with_previous = stack[-1]
            if position[top] < here:
                break
            stack.pop()
            best[top] = max(with_previous, shared)
            shared = min(shared, with_previous)
        if r < n:
            stack.append((r, shared))
    return best


def repeated_windows(runs: list[tuple[tuple[int, int], int, bytes]], length: int, earlier_only: bool) -> list[list[int]]:
    """Of runs with one anchor, (key and position, windows, bytes), the windows that occur
    again in another run, or earlier. Anchors stand at the same place of equal windows, so only
    those at the same distance from the anchor are the same window."""
    suffixes = sorted((data[i : i + length], where, number, i) for number, (where, count, data) in enumerate(runs) for i in range(count))
    common = [0, *[length if a[0] == b[0] else 0 for a, b in zip(suffixes, suffixes[1:])]]
    found: list[list[int]] = [[] for _ in runs]
    if not any(common):
        return found
    rank_of = {s[1:]: r for r, s in enumerate(sorted(suffixes, key=lambda s: s[1:]))}
    position = [rank_of[s[1:]] for s in suffixes]
    best = longest_previous_factors(position, common)
    if not earlier_only:
        later = longest_previous_factors([len(position) - p for p in position], common)
        best = [max(a, b) for a, b in zip(best, later)]
    for (_, _, number, i), n in zip(suffixes, best):
        if n >= length:
            found[number].append(i)
    return found


def merged(starts: list[int]) -> Iterator[tuple[int, int]]:
    """Whole numbers as ranges of numbers that follow one another."""
    begin = before = None
    for x in sorted(starts):
        if before is not None and x != before + 1:
            yield begin, before
            begin = x
        begin = x if begin is None else begin
        before = x
    if before is not None:
        yield begin, before


def _release(df: DataFrame) -> None:
    """Lets the cleaner delete the shuffle files of finished steps now, not at some later time."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, filter_bits: int = FILTER_BITS, group_runs: int = GROUP_RUNS) -> DataFrame:
    """key, lo, hi: windows from lo to hi of the text with that key occur elsewhere too;
    with `keep_first` only those that also occur earlier, by key and place.

    `docs` has key (long) and text (string, not null). Ranges may overlap.
    """
    if not 0 < gram <= length or length - gram > 255:
        raise ValueError("the piece is at most as long as the string, and at most 255 bytes shorter")
    counts = _run_rows(docs, length, gram, "h long", lambda hasher, data, runs: [runs.h])
    often = counts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    often = pin(often, "repeat-anchors")
    twice = Filter.of(F.col("h"), often, filter_bits)
    _release(docs)
    def texts(schema: str, make) -> DataFrame:
        return _run_rows(docs, length, gram, schema, lambda hasher, data, runs: make(hasher, data, runs.chosen(twice.has(runs.h))))

    source, ranges = texts, []
    for size in (BLOCK, 1, None):

        def rows(hasher, data, runs):
            return [runs.h, runs.f, runs.key, runs.where()]

        found = pin(source("h long, f long, key long, place long", rows), "repeat-runs")
        classes = found.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("rep"))
        classes = classes.select("h", "f", "n", F.col("rep.key").alias("rep_key"), F.col("rep.place").alias("rep_place"))
        classes = pin(classes, "repeat-classes")
        _release(docs)
        equal = classes.where("n > 1").select(F.col("h").alias("_h"), F.col("f").alias("_f"), "rep_key", "rep_place")
        settled = found.join(equal, (F.col("h") == F.col("_h")) & (F.col("f") == F.col("_f")))
        if keep_first:
            settled = settled.where("key <> rep_key or place <> rep_place")
        anchor = F.expr("place >> 16")
        ranges.append(settled.select("key", (anchor - F.expr("(place >> 8) & 255")).alias("lo"), (anchor - F.expr("place & 255")).alias("hi")))
        if size is None:
            break

        groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1")
        if not keep_first:
            groups = groups.where("least = 1")
        groups = pin(groups, "repeat-groups")
        open_classes = classes.join(groups.select(F.col("h").alias("_h")), F.col("h") == F.col("_h"), "left_semi")
        asked = Filter.of(F.xxhash64("rep_key", "rep_place"), open_classes, filter_bits)
        large = groups.where(F.col("kinds") > group_runs)
        crowded = Filter.of(F.col("h"), large, filter_bits)
        _release(docs)

        def contexts(hasher, data, runs, asked=asked, crowded=crowded):
            runs = runs.chosen(asked.has(xxh64_long(runs.where(), xxh64_long(runs.key, 42)).view(np.int64)))
            parts = [data[a : b + length].tobytes() for a, b in zip(runs.first, runs.last)]
            return [runs.h, runs.key, runs.where(), pa.array(parts, pa.binary()), crowded.has(runs.h)]

        met = pin(source("h long, key long, place long, part binary, crowd boolean", contexts), "repeat-contexts")
        quiet = met.where("not crowd").drop("crowd").repartition("h").sortWithinPartitions("h", "key", "place")
        ranges.append(quiet.mapInArrow(lambda batches: _settle(batches, length, keep_first), "key long, lo long, hi long"))
        if large.isEmpty():
            break
        source = partial(_block_rows, met.where("crowd"), length, size)
    result = ranges[0]
    for more in ranges[1:]:
        result = result.unionByName(more)
    return result


def _block_rows(met: DataFrame, length: int, size: int, schema: str, make) -> DataFrame:
    """The runs in `met`, cut into blocks of `size` windows; `make` turns them into columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "part", CHUNK):
                parts = batch.column("part").to_pylist()
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                first = np.cumsum(sizes) - sizes
                h, key, place = (batch.column(c).to_numpy() for c in ("h", "key", "place"))
                data = np.frombuffer(b"".join(parts), np.uint8)
                hasher = Hasher(data)
                runs = Runs(key, place >> 16, first, first + sizes - length, first + (place >> 8 & 255), h, h)
                columns = make(hasher, data, blocks_of(hasher, runs, length, size))
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return met.mapInArrow(run, schema)


def _settle(batches: Iterator[pa.RecordBatch], length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Groups of rows with one anchor, in order, to ranges of repeated windows."""
    group: list[tuple[tuple[int, int], int, bytes]] = []
    anchor, rows = None, []

    def close() -> None:
        if len(group) > 1:
            for ((key, first), _, _), starts in zip(group, repeated_windows(group, length, keep_first)):
                rows.extend((key, first + a, first + b) for a, b in merged(starts))

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "lo", "hi"])

    for batch in batches:
        for h, key, place, part in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "place", "part"))):
            if h != anchor:
                close()
                group, anchor = [], h
                if len(rows) > 10_000:
                    yield out()
                    rows = []
            first = (place >> 16) - ((place >> 8) & 255)
            group.append(((key, first), len(part) - length + 1, part))
    close()
    if rows:
        yield out()


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], hi + length))
        else:
            spans.append((lo, hi + length))
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, filter_bits: int = FILTER_BITS, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), one row per input row.

    Removes each UTF-8 byte that is covered by a string of `length` bytes which starts
    anywhere else too, in the same text or another; with `keep_first` which starts
    earlier too, by doc_id and place, so that one copy stays. A null text is empty. Texts
    shorter than `length` stay. Where doc_ids repeat or are null, rows are told apart by
    doc_id and text together, and "earlier" follows a hash of these; rows equal in both are
    copies of each other, and with `keep_first` none of them goes for the other's sake.
    Other columns are not read. An empty table gives an empty result.
    """
    own_keys = docs.agg(F.count("doc_id").alias("ids"), F.count(F.lit(1)).alias("n")).first()
    unique = own_keys.ids == own_keys.n and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    text = text_or_empty()
    key = F.col("doc_id").cast("long") if unique else F.xxhash64("doc_id", text)
    rows = docs.select("doc_id", key.alias("key"), text.alias("text"))
    long_enough = rows.where(F.octet_length("text") >= length).select("key", "text")
    starts = repeated_starts(long_enough, length, gram, keep_first, filter_bits, group_runs)
    by_text = starts.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    by_text = pin(by_text.withColumnRenamed("key", "_key"), "repeat-ranges")
    _release(docs)
    touched = Filter.of(F.col("_key"), by_text, filter_bits)

    @F.pandas_udf("boolean")
    def may_change(keys: pd.Series) -> pd.Series:
        return pd.Series(touched.has(keys.to_numpy(np.int64)))

    marked = rows.withColumn("_open", may_change("key"))
    zero = F.lit(0).cast("long")
    same = marked.where("not _open").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text"):
                out = []
                for value, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                    data, done, kept = value.as_buffer(), 0, []
                    spans = covered([(r["lo"], r["hi"]) for r in ranges or []], length)
                    for a, b in spans:
                        kept.append(data[done:a].to_pybytes())
                        done = b
                    kept = b"".join([*kept, data[done:].to_pybytes()])
                    out.append((data.size, data.size - len(kept), len(spans), kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = marked.where("_open").join(by_text, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "ranges")
    changed = changed.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return same.unionByName(changed)
