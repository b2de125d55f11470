"""Packing token ids into sequences: vector bin packing by the dot-product heuristic.

An item is a piece of a document with a demand in three dimensions: tokens, segments (one
for each piece) and loss-bearing tokens. A sequence has a limit in each. The next item for
the open sequence is the one that fits and whose demand, weighed by what is scarce over
all items, points most along what the sequence has left. When no item fits, the largest
one is cut to fill the gap, so sequences are full unless another limit stops them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import slices
from lakewright.llm.tokens import encode, vocabulary_path

#: Documents whose rests are packed together in a task; bounds its memory.
WINDOW = 4096
OUTPUT = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


@dataclass
class Item:
    """A piece of a document; `ids` and `loss` (0 or 1 each) are its own, `start` its place there."""

    doc: object
    start: int
    ids: np.ndarray
    loss: np.ndarray
    doc_tokens: int

    def bearing(self) -> int:
        """Its loss-bearing tokens."""
        return int(np.count_nonzero(self.loss))

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, self.bearing()

    def cut(self, length: int) -> tuple[Item, Item]:
        return (
            Item(self.doc, self.start, self.ids[:length], self.loss[:length], self.doc_tokens),
            Item(self.doc, self.start + length, self.ids[length:], self.loss[length:], self.doc_tokens),
        )


def fitting_prefix(item: Item, room: np.ndarray) -> int:
    """How many first tokens of the item the room takes."""
    if room[1] < 1:
        return 0
    longest = min(len(item.ids), int(room[0]))
    if np.count_nonzero(item.loss[:longest]) <= room[2]:
        return longest
    spent = np.cumsum(item.loss[:longest])
    return int(np.searchsorted(spent, room[2], side="right")) if longest else 0


class Packer:
    """Packs items of one task; sequences come out as lists of pieces.

    Items with equal demand form a class, so a step looks at classes, not at items.
    """

    def __init__(self, limits: Limits):
        self.limit = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.classes: dict[tuple[int, int, int], list[Item]] = defaultdict(list)
        self.waiting = 0

    def add(self, item: Item) -> Iterator[list[Item]]:
        """Takes an item; full sequences that it makes alone come out at once."""
        while True:
            length = fitting_prefix(item, self.limit)
            if length == 0:
                raise ValueError("a limit leaves no room for a single token")
            if length == len(item.ids) and length < self.limit[0]:
                break
            head, item = item.cut(length)
            yield [head]
            if not len(item.ids):
                return
        self.classes[item.demand()].append(item)
        self.waiting += 1

    def flush(self, keep_last: bool) -> Iterator[list[Item]]:
        """Packs what waits. With `keep_last` the last sequence, which is not full, waits
        on for later items."""
        keys = list(self.classes)
        demand = np.array(keys, float).reshape(-1, 3)
        counts = np.array([len(self.classes[k]) for k in keys], float)
        while counts.sum():
            room, sequence = self.limit.copy(), []
            while True:
                there = counts > 0
                fits = there & (demand <= room).all(axis=1)
                if fits.any():
                    scarce = (demand * counts[:, None]).sum(axis=0) / self.limit
                    weight = scarce / max(scarce.sum(), 1e-12) / self.limit**2
                    gain = np.where(fits, demand @ (weight * room), -1.0)
                    best = int(np.argmax(gain))
                    item = self.classes[keys[best]].pop()
                    counts[best] -= 1
                else:
                    taken = self._cut(keys, counts, there, demand, room)
                    if taken is None:
                        break
                    item, rest = taken
                    key = rest.demand()
                    if key in keys:
                        at = keys.index(key)
                    else:
                        at = len(keys)
                        keys.append(key)
                        demand, counts = np.vstack([demand, key]), np.append(counts, 0.0)
                    self.classes[key].append(rest)
                    counts[at] += 1
                sequence.append(item)
                room -= item.demand()
            if keep_last and not counts.sum() and room[0] > 0:
                for item in sequence:
                    self.classes[item.demand()].append(item)
                self.waiting = len(sequence)
                self.classes = defaultdict(list, {k: v for k, v in self.classes.items() if v})
                return
            yield sequence
        self.classes.clear()
        self.waiting = 0

    def _cut(self, keys, counts, there, demand, room) -> tuple[Item, Item] | None:
        """The largest item, cut to what the room takes; None if nothing goes in."""
        if room[0] < 1 or room[1] < 1 or not there.any():
            return None
        at = int(np.argmax(np.where(there, demand[:, 0], -1.0)))
        length = fitting_prefix(self.classes[keys[at]][-1], room)
        if length == 0:
            return None
        item = self.classes[keys[at]].pop()
        counts[at] -= 1
        return item.cut(length)


def _pieces(sequences: Iterator[list[Item]], first: int) -> Iterator[tuple]:
    for number, sequence in enumerate(sequences, first):
        offset = 0
        for item in sequence:
            crc = zlib.crc32(np.ascontiguousarray(item.ids, "<u4").tobytes())
            yield item.doc, item.start, len(item.ids), crc, item.doc_tokens, number, offset, item.bearing()
            offset += len(item.ids)


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    names = [part.split()[0] for part in OUTPUT.split(", ")]
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], key), *[pa.array(c, pa.int64()) for c in columns[1:]]]
    return pa.record_batch(arrays, names=names)


def _pack_items(items: Iterator[Item], limits: Limits, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits)

    def sequences() -> Iterator[list[Item]]:
        for item in items:
            yield from packer.add(item)
            if packer.waiting >= WINDOW:
                yield from packer.flush(keep_last=True)
        yield from packer.flush(keep_last=False)

    held: list[tuple] = []
    for row in _pieces(sequences(), TaskContext.get().partitionId() << 36):
        held.append(row)
        if len(held) >= 20_000:
            yield _batch(held, key)
            held = []
    if held:
        yield _batch(held, key)


def pack(docs: DataFrame, limits: Limits = Limits(), path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of texts in sequences: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss (loss-bearing tokens, here all).

    Each text is encoded and `end_id` added; a null or empty text is that id alone. Each
    id lies in one piece. Every scan task packs its own rows, so nothing is shuffled and no
    key can make a task large; sequence ids follow from the task's number, so the same
    files and settings give the same result. At most one sequence of a task is short, but
    for those that hold `limits.segments` pieces. Repeated rows and rows without doc_id are
    packed like others. Columns other than doc_id and text are not read. An empty table
    gives no rows.
    """
    path = path or vocabulary_path()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = key_type(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[Item]:
            for batch in slices(batches, "text", 4 << 20):
                texts = batch.column("text").to_pylist()
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts, path)):
                    ids = np.append(ids, np.uint32(end_id))
                    yield Item(doc, 0, ids, np.ones(len(ids), np.int8), len(ids))

        yield from _pack_items(items(), limits, kind)

    return source.mapInArrow(run, OUTPUT.format(source.schema["doc_id"].dataType.simpleString()))


def key_type(source: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["doc_id"].dataType)


def pack_marked(rows: DataFrame, doc_id: str, ids: str, loss: str, limits: Limits = Limits()) -> DataFrame:
    """The same for ids that are there already: `ids` array<int>, `loss` an array of 0 and 1
    as long, for instance 1 on the answers of instruction data.

    Null or empty ids give no piece. A null or shorter loss counts as 0 beyond its end.
    """
    source = rows.select(
        F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<long>").alias("ids"), F.col(loss).cast("array<long>").alias("loss")
    )
    kind = key_type(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[Item]:
            for batch in batches:
                for doc, own, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "loss"))):
                    if own:
                        mask = np.zeros(len(own), np.int8)
                        marks = (marks or [])[: len(own)]
                        mask[: len(marks)] = [1 if m else 0 for m in marks]
                        yield Item(doc, 0, np.array(own, "<u4"), mask, len(own))

        yield from _pack_items(items(), limits, kind)

    return source.mapInArrow(run, OUTPUT.format(source.schema["doc_id"].dataType.simpleString()))


def padding(column: Column, tokens: int = 1024) -> Column:
    """The padding of a sequence of that length: none at a power of two, else up to `tokens`."""
    power = column.bitwiseAND(column - 1) == 0
    return F.when(power, F.lit(0)).otherwise(F.lit(tokens) - column)
