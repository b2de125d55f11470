"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints
within the radius share a variant, so one shuffle on variants finds every link. The
fingerprints of a variant are kept as the set of flipped places, one number of fixed
width, so no group is ever gathered: whatever shares a variant differs from it in one
bit at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import entering, pin, slices
from lakewright.llm.components import connected_components

SEED = 42
CHUNK = 1 << 18
#: Ids that are sent to all tasks at most, and their bytes as text.
SENT_ROWS, SENT_BYTES = 1 << 21, 64 << 20


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of `width` words; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashed = [digest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())]
    return np.array(hashed, np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; bit i is 1 if it is set in over half of the shingle hashes. No words: 0."""
    hashes = shingle_hashes((text or "").encode(), width)
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), CHUNK):
        part = hashes[begin : begin + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("simhash")
        for batch in slices(batches, "text"):
            values = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            values = np.array(values, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(values)], names=["doc_id", "fp"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links u, v between fingerprints (`fp`, each once) that differ in `radius` bits or fewer.

    Not every close pair is listed: those that meet in a variant are all tied to the
    smallest of them, which leaves the components as they are. `radius` is 0, 1 or 2: half
    of it is one bit at most, hence 65 variants and 65 fingerprints for each.
    """
    if radius not in (0, 1, 2):
        raise ValueError("the radius is 0, 1 or 2")
    flips = F.sequence(F.lit(-1), F.lit(63 if radius else -1))
    flipped = F.when(F.col("flip") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, flip)")))
    met = (
        distinct.select("fp", F.explode(flips).alias("flip"))
        .select(flipped.alias("variant"), F.expr("if(flip < 0, 0L, shiftleft(1L, flip))").alias("bit"), F.expr("flip < 0").alias("own"))
        .groupBy("variant")
        .agg(F.bit_or("bit").alias("bits"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    members = F.expr(
        "concat(if(own, array(variant), array()),"
        " transform(filter(sequence(0, 63), i -> (bits & shiftleft(1L, i)) <> 0), i -> variant ^ shiftleft(1L, i)))"
    )
    return (
        met.select(members.alias("m"))
        .select(F.array_min("m").alias("u"), F.explode("m").alias("v"))
        .where("u <> v")
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
        .distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (signed long) and component_id, one row per input row.

    component_id is the smallest doc_id that can be reached over links between
    fingerprints at most `radius` bits apart. Texts without words, null texts too, have
    fingerprint 0 and are linked like any other. Repeated rows stay; rows without doc_id get
    the id of their component, null if it has none at all. Other columns of `docs` are
    not read. An empty table gives an empty result.
    """
    rows = pin(fingerprints(docs, width), "simhash")
    distinct = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(ball_links(distinct, radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left")
    rooted = pin(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def sendable(ids: DataFrame) -> DataFrame:
    """The ids, written once; up to SENT_ROWS and SENT_BYTES of them go to all tasks, so that no texts are
    shuffled to meet them. More are joined as Spark plans it."""
    ids = pin(ids, "simhash-ids")
    known = ids.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("doc_id").cast("string"))).alias("bytes")).first()
    return F.broadcast(ids) if known.n <= SENT_ROWS and (known.bytes or 0) <= SENT_BYTES else ids


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs` but for all of a component save the one with its smallest doc_id.

    `classes` is what near_duplicates or similar_documents returns for `docs`. Rows without doc_id stay, since
    nothing tells them apart. Of repeated rows with one doc_id one stays.
    """
    gone = sendable(classes.where("doc_id <> component_id").select("doc_id").distinct())
    repeated = sendable(classes.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
