"""Near-duplicates by SimHash and by the similarity of word shingles.

SimHash fingerprints of three-word shingles link by ball hashing, as in `simhash`. Where
fingerprints differ by more than the radius, banded min-hashes propose and exact sets decide:

Every distinct text has BANDS keys, each of ROWS min-hashes of its shingle set; two texts of
similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, 0.9997 at 0.8. Texts with
a key are sorted by key, each in another order, and meet the text before them and
the first one of their chunk. Links are the pairs whose sets have the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import entering, pin, slices, text_or_empty
from lakewright.llm.components import connected_components
from lakewright.llm.repeats import FILTER_BITS, Filter
from lakewright.llm.simhash import ball_links, fingerprint, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
CHUNK = 1 << 13
#: Partners of one text that meet it in one place.
LOT = 256
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    return np.unique(shingle_hashes((text or "").encode(), width))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key for each band; sets without a shingle share theirs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(hashes), CHUNK):
            np.minimum(least, (FACTORS * hashes[begin : begin + CHUNK]).min(axis=1), out=least)
    packed = least.tobytes()
    size = ROWS * 8
    keys = [xxhash.xxh64_intdigest(packed[i * size : (i + 1) * size], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of two empty ones is 1."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, tid (a hash of the text) and the text."""
    return docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("tid"), "text")


def banded(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, tid, fp (SimHash fingerprint), n (shingles in the set) and keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("near duplicates")
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            marks = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            sets = [shingle_set(t, width) for t in texts]
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("tid"), marks, n, keys], names=["doc_id", "tid", "fp", "n", "keys"])

    source = numbered(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, tid long, fp long, n long, keys array<long>")


def proposed(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs u < v of texts that share a key and whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "u", "v"]
        carried = None  # key, first text of it in this chunk, last text; with their sizes
        opening = None

        def border(key, tid) -> pa.RecordBatch:
            return pa.record_batch([pa.array([int(x)], pa.int64()) for x in (key, tid)] + [pa.nulls(1, pa.int64())], names=names)

        for batch in batches:
            key, tid, n = (batch.column(c).to_numpy() for c in ("key", "tid", "n"))
            if not len(key):
                continue
            if opening is None:
                opening = key[0]
                yield border(key[0], tid[0])
            if carried:
                key, tid, n = (np.concatenate((c, a)) for c, a in zip(carried, (key, tid, n)))
            place = np.arange(len(key))
            first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0))
            for other in (first, np.maximum(place - 1, first)):
                fits = (other != place) & (place >= (2 if carried else 0))
                fits &= np.minimum(n, n[other]) >= least * np.maximum(n, n[other])
                a, b = tid[fits], tid[other[fits]]
                yield pa.record_batch([pa.array(key[fits]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names)
            ends = [first[-1], len(key) - 1]
            carried = [c[ends] for c in (key, tid, n)]
        if carried and carried[0][0] != opening:
            yield border(carried[0][0], carried[1][0])

    keys = rows.select("tid", "n", F.posexplode("keys").alias("band", "key")).select("key", "tid", "n").distinct()
    keys = keys.withColumn("turn", F.xxhash64("key", "tid"))
    found = keys.repartitionByRange("key", "turn", "tid").sortWithinPartitions("key", "turn", "tid").select("key", "tid", "n")
    found = pin(found.mapInArrow(run, "key long, u long, v long"), "similar-met")
    heads = found.where("v is null").select("key", "u")
    one = heads.groupBy("key").agg(F.min("u").alias("least")).withColumnRenamed("key", "_key")
    over = heads.join(one, F.col("key") == F.col("_key")).select(F.col("least").alias("u"), F.col("u").alias("v"))
    return found.where("v is not null").select("u", "v").unionByName(over).where("u <> v").distinct()


def texts_of(docs: DataFrame, pairs: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """tid and text, each once, of the texts of `pairs` (u, v) and of those few others that a filter of a
    bounded size lets through by mistake.

    The filter goes to all tasks and copies are put together before the shuffle, so that of a corpus
    only the texts that are looked at are sent, each copied one once a task.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("tid")).distinct()
    held = Filter.of(F.col("tid"), wanted, most_bits)

    @F.pandas_udf("boolean")
    def is_held(tids: pd.Series) -> pd.Series:
        return pd.Series(held.has(tids.to_numpy(np.int64)))

    return numbered(docs).select("tid", "text").where(is_held("tid")).groupBy("tid").agg(F.min("text").alias("text"))


def verified(texts: DataFrame, pairs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (u, v) of `texts` (tid, text) whose shingle sets have at least the similarity.

    The texts of the pairs of one u come together in lots of about LOT, each behind u's own text, so
    a task holds two sets at a time however many partners a text has. Texts travel, not sets,
    which are as large and cannot be compressed.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("near duplicates")
        lead = np.empty(0, np.uint64)
        for batch in batches:
            for part in slices([batch], "text", 4 << 20):
                good = []
                for first, text in zip(part.column("first").to_pylist(), part.column("text").to_pylist()):
                    held = shingle_set(text, width)
                    if first:
                        lead = held
                    good.append(not first and similarity(lead, held) >= least)
                found = part.filter(pa.array(good, pa.bool_()))
                yield pa.record_batch([found.column("u"), found.column("tid")], names=["u", "v"])

    counts = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "_u")
    lots = F.greatest(F.lit(1), F.expr(f"n div {LOT}"))
    dealt = pairs.join(counts, F.col("u") == F.col("_u")).select("u", "v", F.pmod(F.xxhash64("v"), lots).alias("lot"))
    leads = dealt.select("u", F.col("u").alias("v"), "lot").distinct()
    routes = dealt.withColumn("first", F.lit(False)).unionByName(leads.withColumn("first", F.lit(True)))
    sent = routes.join(texts, F.col("v") == F.col("tid")).select("u", "lot", "first", "tid", "text")
    sent = sent.repartition("u", "lot").sortWithinPartitions("u", "lot", F.desc("first"), "tid")
    return pin(sent.select("u", "first", "tid", "text").mapInArrow(compare, "u long, v long"), "similar-links")


def fingerprint_links(rows: DataFrame, radius: int = 2) -> DataFrame:
    """Links u, v between texts (`tid`, `fp`): those of one component of fingerprints, at most `radius`
    bits apart each, are tied to one of them."""
    marks = pin(rows.groupBy("fp").agg(F.min("tid").alias("least")), "similar-fingerprints")
    roots = connected_components(ball_links(marks.select("fp"), radius))
    rooted = marks.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("u"))
    ties = rooted.join(heads, "root").select("_fp", "u")
    return rows.join(ties, F.col("fp") == F.col("_fp")).select("u", F.col("tid").alias("v")).where("u <> v").distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are in different components."""
    left = roots.select(F.col("node").alias("_u"), F.col("root").alias("ru"))
    right = roots.select(F.col("node").alias("_v"), F.col("root").alias("rv"))
    met = pairs.join(left, F.col("u") == F.col("_u"), "left").join(right, F.col("v") == F.col("_v"), "left")
    return met.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def similar_documents(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """doc_id, tid and component_id, one row per input row.

    component_id is the smallest doc_id that can be reached over links between texts whose sets of
    `width`-word shingles have a Jaccard similarity of `least` or more, or, with a `radius`, whose
    SimHash fingerprints differ in so many bits at most. Of the latter a first round checks one pair of each text
    that the fingerprints leave apart; a second one all other pairs that are not together then.
    Null and empty texts and those of blanks alone have the empty set of shingles and are one group; a text of
    fewer words than `width` is one shingle. Repeated rows, and rows without doc_id, are like any
    other: equal texts are together, and a group without any doc_id has none as its component_id.
    Other columns are not read; an empty table gives no rows.
    """
    rows = pin(banded(docs, width), "similar-rows")
    pairs = pin(proposed(rows, least), "similar-pairs")
    marked = rows.select(F.col("tid").alias("u"), F.col("tid").alias("v")).limit(0) if radius is None else fingerprint_links(rows, radius)
    links = pin(marked, "similar-marked")
    roots = pin(connected_components(links), "similar-roots")
    first = apart(pairs, roots).groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    first = pin(first, "similar-first")
    links = links.unionByName(verified(texts_of(docs, first), first, width, least))
    roots = pin(connected_components(links), "similar-roots")
    others = pin(apart(pairs, roots).join(first, ["u", "v"], "left_anti"), "similar-apart")
    links = links.unionByName(verified(texts_of(docs, others), others, width, least))
    roots = pin(connected_components(links), "similar-roots")
    texts = rows.groupBy("tid").agg(F.min("doc_id").alias("least")).join(roots, F.col("tid") == F.col("node"), "left")
    rooted = pin(texts.select("tid", "least", F.coalesce("root", "tid").alias("root")), "similar-rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("tid", "root").join(smallest, "root").select(F.col("tid").alias("_tid"), "component_id")
    return rows.join(classes, F.col("tid") == F.col("_tid")).select("doc_id", "tid", "component_id")
