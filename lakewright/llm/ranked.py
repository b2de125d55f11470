"""Ranked lexical search of a set of items over all documents, by presence masks.

Documents are read in blocks. A block keeps for each term of the items which documents hold it
(a bitmap) and how often. An item's documents in a block are grouped by the set of the item's
terms that they hold: a group of documents is split by one term's bitmap after the other, the
group with the highest possible score first. Groups whose set is settled are scored; as soon as
no group left can reach the item's k-th best score, the block is finished for that item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import entering, pin, ship_package, slices, text_or_empty

#: Bytes of a UTF-8 text that separate terms, and what becomes of each byte: A-Z are lowered.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

BLOCK_BYTES = 4 << 20
ITEM_BYTES = 4 << 20
#: One block in so many is searched first and gives the scores that the others must reach.
LOTS = 16
#: Smaller groups are scored as they are, whatever their masks.
FEW = 12
NO_DOC = (1 << 63) - 1
BLOCK = (
    "lot int, documents long, total long, doc_ids array<long>, sizes array<long>, "
    "terms array<int>, held array<int>, docs array<int>, times array<int>"
)
FOUND = "item long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(FOLD).split()


def blocks_of(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of documents: sizes of all with a term, and postings of the vocabulary's terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("ranked")
        number = known.value
        for batch in batches:
            for part in slices([batch], "text", BLOCK_BYTES):
                ids, sizes, found, owner = [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    terms = terms_of(text)
                    if not terms:
                        continue
                    here = [t for t in map(number.get, terms) if t is not None]
                    owner.append(np.full(len(here), len(ids), np.int64))
                    found.append(np.array(here, np.int64))
                    ids.append(doc_id)
                    sizes.append(len(terms))
                if not ids:
                    continue
                pairs, times = np.unique(np.concatenate(found) * len(ids) + np.concatenate(owner), return_counts=True)
                terms, held = np.unique(pairs // len(ids), return_counts=True)
                lot = hash((ids[0], sizes[0], len(ids), len(pairs))) % LOTS
                columns = [ids, sizes, terms, held, pairs % len(ids), times]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                lists = [pa.array([c if isinstance(c, list) else c.astype(k.to_pandas_dtype())], pa.list_(k)) for c, k in zip(columns, kinds)]
                heads = [pa.array([lot], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64())]
                names = [field.split()[0] for field in BLOCK.split(", ")]
                yield pa.RecordBatch.from_arrays([*heads, *lists], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return texts.mapInArrow(run, BLOCK)


def holders(blocks: DataFrame) -> dict[int, int]:
    """For each term of the vocabulary how many documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[int] = Counter()
        for batch in batches:
            for terms, held in zip(batch.column("terms"), batch.column("held")):
                count.update(dict(zip(terms.values.to_pylist(), held.values.to_pylist())))
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(list(count), pa.int32()), "held": pa.array(list(count.values()), pa.int64())}
        )

    sums = blocks.select("terms", "held").mapInArrow(run, "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))
    return {r.term: r.held for r in sums.collect()}


@dataclass(frozen=True)
class Asked:
    """Items as (number, terms, how often each is in the item), weights by term, N and L."""

    items: list[tuple[int, np.ndarray, np.ndarray]]
    weights: np.ndarray
    documents: int
    total: int


class Block:
    """One block of documents made ready for searches."""

    def __init__(self, row: dict[str, np.ndarray], asked: Asked):
        self.ids, self.terms = row["doc_ids"], row["terms"].astype(np.int64)
        self.rows = len(self.ids)
        length = 100 - 75 + 75 * row["sizes"] * asked.documents // asked.total
        self.docs, times = row["docs"].astype(np.int64), row["times"].astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(row["held"], dtype=np.int64)])
        self.parts = 1_000_000_000 * times // (1000 * times + 8 * length[self.docs])
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.ends)) * self.rows + self.docs
        self.most = np.maximum.reduceat(self.parts, self.ends[:-1]) if len(self.terms) else self.parts
        self.bitmaps: dict[int, int] = {}

    def bitmap(self, place: int) -> int:
        """The documents that hold the term at a place, as the bits of a whole number."""
        if place not in self.bitmaps:
            bits = np.zeros(self.rows, np.uint8)
            bits[self.docs[self.ends[place] : self.ends[place + 1]]] = 1
            self.bitmaps[place] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return self.bitmaps[place]

    def members(self, group: int) -> np.ndarray:
        held = np.frombuffer(group.to_bytes((self.rows + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(held, bitorder="little"))

    def scores(self, docs: np.ndarray, places: np.ndarray, factors: np.ndarray) -> np.ndarray:
        wanted = places[:, None] * self.rows + docs
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (np.where(self.keys[at] == wanted, self.parts[at], 0) * factors[:, None]).sum(axis=0)

    def search(self, terms: np.ndarray, factors: np.ndarray, best: list[tuple[int, int]], k: int, least: int) -> None:
        """Puts the item's best documents of this block into `best`, a heap of at most `k`
        (score, -doc_id); scores below `least` do not count."""
        places = np.searchsorted(self.terms, terms)
        there = places < len(self.terms)
        there[there] = self.terms[places[there]] == terms[there]
        places, factors = places[there], factors[there]
        gains = self.most[places] * factors
        if not len(places) or gains.sum() < (best[0][0] if len(best) == k else least):
            return
        order = np.argsort(-gains, kind="stable")
        places, factors, gains = places[order], factors[order], gains[order].tolist()
        maps = [self.bitmap(place) for place in places.tolist()]
        whole = 0
        for held in maps:
            whole |= held
        groups = [(-sum(gains), 0, whole)]
        while groups:
            limit, depth, group = heapq.heappop(groups)
            if -limit < (best[0][0] if len(best) == k else least):
                return
            while depth < len(maps) and group.bit_count() > FEW:
                inside = group & maps[depth]
                if inside != group:
                    heapq.heappush(groups, (limit + gains[depth], depth + 1, group ^ inside))
                    if not inside:
                        break
                group, depth = inside, depth + 1
            else:
                docs = self.members(group)
                for score, doc_id in zip(self.scores(docs, places, factors).tolist(), self.ids[docs].tolist()):
                    if score < least:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -doc_id))
                    elif (score, -doc_id) > best[0]:
                        heapq.heapreplace(best, (score, -doc_id))


def search_blocks(blocks: DataFrame, asked: Asked, k: int, least: dict[int, int]) -> DataFrame:
    """For each item the k best documents of each partition, none below its least score."""
    wanted = blocks.sparkSession.sparkContext.broadcast((asked, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("ranked")
        asked, least = wanted.value
        best: dict[int, list[tuple[int, int]]] = {number: [] for number, _, _ in asked.items}
        for batch in batches:
            columns = {name: batch.column(name) for name in ("doc_ids", "sizes", "terms", "held", "docs", "times")}
            for n in range(batch.num_rows):
                row = {name: column[n].values for name, column in columns.items()}
                row["doc_ids"] = row["doc_ids"].fill_null(NO_DOC)
                block = Block({name: values.to_numpy() for name, values in row.items()}, asked)
                for number, terms, times in asked.items:
                    block.search(terms, times * asked.weights[terms], best[number], k, least.get(number, 1))
        found = [(number, -doc_id, score) for number, heap in best.items() for score, doc_id in heap]
        ids = [None if doc_id == NO_DOC else doc_id for _, doc_id, _ in found]
        yield pa.RecordBatch.from_pydict(
            {"item": pa.array([f[0] for f in found], pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array([f[2] for f in found], pa.int64())}
        )

    return blocks.mapInArrow(run, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; a document without id comes last."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_items(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame | None:
    """item, rank, doc_id, score for items that fit one pass; None if nothing can be found."""
    vocabulary = {term: n for n, term in enumerate(sorted({t for _, terms in items for t in terms}))}
    blocks = pin(blocks_of(docs, vocabulary), "postings")
    sums = blocks.agg(F.sum("documents").alias("n"), F.sum("total").alias("total")).first()
    if not sums.n or not vocabulary:
        return None
    held = holders(blocks)
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in held.items():
        weights[term] = math.floor(1000 * math.log((2 * sums.n + 2) / (2 * df + 1)))
    numbered = []
    for number, terms in items:
        times = Counter(vocabulary[t] for t in terms)
        order = sorted(t for t in times if t in held)
        numbered.append((number, np.array(order, np.int64), np.array([times[t] for t in order], np.int64)))
    asked = Asked(numbered, weights, sums.n, sums.total)
    sample = pin(first_of(search_blocks(blocks.where("lot = 0"), asked, k, {}), k), "first-lot")
    least = {r.item: r.score for r in sample.where(F.col("rank") == k).select("item", "score").collect()}
    others = search_blocks(blocks.where("lot <> 0"), asked, k, least)
    return first_of(others.unionByName(sample.drop("rank")), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank int, doc_id, score: each item's `k` highest scores above 0 among all documents.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z lowered. A document's score
    for an item sums over the item's terms, repeats included, the term's weight times
    1000000000 tf div (1000 tf + 8 m), as `Asked` and `Block` say; equal scores go by ascending doc_id. Null and
    empty texts hold no terms and are found by none; a repeated document is found each time; one
    without doc_id comes last among equals. An item without terms or without a match gives no rows, a
    repeated item its rows each time. Items go through in passes of ITEM_BYTES, so the vocabulary
    that the tasks get is bounded; each pass reads the documents once. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    text = text_or_empty()
    distinct = items.select("item_id", text.alias("text")).groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    distinct = pin(distinct.where("text <> ''"), "items")
    total = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // ITEM_BYTES))
    lot = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    schema = f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, copies long"
    results = []
    for number in range(passes):
        rows = distinct.where(lot == number).orderBy("item_id", "text").collect()
        found = search_items(docs, [(n, terms_of(r.text.encode())) for n, r in enumerate(rows)], k)
        if found is not None:
            names = docs.sparkSession.createDataFrame([(n, r.item_id, r.copies) for n, r in enumerate(rows)], schema)
            found = found.join(F.broadcast(names), "item").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            results.append(pin(found.select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not results:
        return distinct.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
