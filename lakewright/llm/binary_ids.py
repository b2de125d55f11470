"""Token ids in raw binary shards with a minimal perfect hash index for keyed access.

A shard is one file written by Spark's own writer: the ids of its documents one after
another as little-endian unsigned integers (two bytes each when the vocabulary allows,
else four), each document ended by id 0. The writer puts its record separator behind
every record; the separator is set to the zero bytes of id 0, so records need no framing.
Behind the ids stands a directory (key and number of ids of each document) and a footer.

The index deals keys to buckets by hash. A bucket is one row: a minimal perfect hash of its
keys (displacements found by hash-and-displace) and, by slot, a fingerprint of the key,
the shard, the offset and the number of ids. A lookup computes a bucket and a slot and
compares one fingerprint, whatever the number of documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.llm.common import bytes_of, pin, slices
from lakewright.llm.tokens import encode, encoder, vocabulary_path
from lakewright.session import scratch_path

#: Stands for a missing doc_id in files and index.
NO_KEY = -(1 << 63)
SHARD_TEXT_BYTES = 24 << 20
BUCKET_KEYS = 16_384
FOOTER = "<4sIQQQ"
FOOTER_BYTES = struct.calcsize(FOOTER)
MAGIC = b"IDS1"
ENTRY = np.dtype([("key", "<i8"), ("n", "<u4")])
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_ids", "<u8")])


def mix64(x: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """The finaliser of SplitMix64 over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: n distinct keys to the slots 0 to n - 1.

    A key's group (about two keys) has a displacement d. d >= 0: the slot is
    mix64(key, d + 2) mod n; d < 0: the slot is -d - 1.
    """

    def __init__(self, n: int, displacements: np.ndarray):
        self.n, self.displacements = n, displacements

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys = keys.astype(np.int64).view(np.uint64)
        n = len(keys)
        groups = max(1, n // 2)
        group = (mix64(keys) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        counts = np.bincount(group, minlength=groups)
        begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
        displacements = np.zeros(groups, np.int64)
        taken = np.zeros(n, bool)
        for g in np.argsort(-counts, kind="stable"):
            size = counts[g]
            if size <= 1:
                break
            own, first = keys[order[begins[g] : begins[g] + size]], 0
            while True:
                seeds = np.arange(first, first + 64)
                slots = (mix64(own[None, :], seeds[:, None] + 2) % np.uint64(n)).astype(np.int64)
                ranked = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    at = int(np.argmax(good))
                    displacements[g] = first + at
                    taken[slots[at]] = True
                    break
                first += 64
        singles = np.flatnonzero(counts == 1)
        displacements[singles] = -np.flatnonzero(~taken)[: len(singles)] - 1
        return cls(n, displacements.astype("<i8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64).view(np.uint64)
        d = self.displacements[(mix64(keys) % np.uint64(len(self.displacements))).astype(np.int64)]
        far = (mix64(keys, np.maximum(d, 0) + 2) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -d - 1, far)


def key_fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64), 1) >> np.uint64(32)).astype("<u4")


@dataclass(frozen=True)
class IdStore:
    """Where the shards are, the bytes of an id, and the index."""

    path: str
    width: int
    index: DataFrame
    digests: DataFrame
    buckets: int


def write_shards(docs: DataFrame, folder: str, path: str, shard_text_bytes: int = SHARD_TEXT_BYTES) -> int:
    """Writes the ids of `docs` to shards in ascending doc_id order; returns the width."""
    width = 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4
    kind = f"<u{width}"
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)).alias("key")
    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    shards = max(1, -(-bytes_of(rows) // shard_text_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, payload = [], 0
        for batch in batches:
            for part in slices([batch], "text", 4 << 20):
                texts = part.column("text").to_pylist()
                values = [ids.astype(kind).tobytes() for ids in encode(texts, path)]
                lengths = np.fromiter(map(len, values), np.int64, len(values)) // width + 1
                entry = np.empty(len(values), ENTRY)
                entry["key"], entry["n"] = part.column("key").to_numpy(), lengths
                entries.append(entry)
                payload += int(lengths.sum()) * width
                yield pa.record_batch([pa.array(values, pa.binary())], names=["value"])
        if entries:
            directory = np.concatenate(entries)
            footer = struct.pack(FOOTER, MAGIC, width, TaskContext.get().partitionId(), len(directory), payload)
            yield pa.record_batch([pa.array([directory.tobytes() + footer], pa.binary())], names=["value"])

    ordered = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    raw = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.text(folder, lineSep="\0" * width)
    return width


def parse_shard(content: bytes) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Shard number, width, directory, and all ids of one file; None for an empty file."""
    if not content:
        return None
    width = next(w for w in (2, 4) if content[-w - FOOTER_BYTES : -w][:4] == MAGIC and not any(content[-w:]))
    _, width, shard, n, payload = struct.unpack(FOOTER, content[-width - FOOTER_BYTES : -width])
    begin = len(content) - width - FOOTER_BYTES - n * ENTRY.itemsize
    directory = np.frombuffer(content, ENTRY, n, begin)
    return shard, width, directory, np.frombuffer(content, f"<u{width}", payload // width)


def _one_file_at_a_time(spark: SparkSession) -> SparkSession:
    """A session of its own in which a shard is a batch, so that a task holds one of them."""
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return own


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """key, shard, run_offset, offset, n_ids, ids_crc32 of each document in the files.

    Offsets count ids; run_offset is that of the first document with the same key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                got = parse_shard(content.as_buffer().to_pybytes())
                if got is None:
                    continue
                shard, _, directory, ids = got
                ends = np.cumsum(directory["n"].astype(np.int64))
                begins = ends - directory["n"]
                new = np.concatenate(([True], directory["key"][1:] != directory["key"][:-1]))
                runs = begins[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [directory["key"], np.full(len(runs), shard, np.int64), runs, begins, directory["n"].astype(np.int64), np.array(crcs, np.int64)]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    names = ["key", "shard", "run_offset", "offset", "n_ids", "ids_crc32"]
    files = _one_file_at_a_time(spark).read.format("binaryFile").load(folder).select("content")
    digests = files.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    path = scratch_path(spark, "id-digests")
    digests.write.parquet(path)
    return spark.read.schema(digests.schema).parquet(path)


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def build_index(digests: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: bucket, n, displacements, slots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy()
        hashed = PerfectHash.build(keys)
        slots = np.empty(len(keys), SLOT)
        at = hashed.slots(keys)
        slots["fingerprint"][at] = key_fingerprint(keys)
        for name in ("shard", "offset", "n_ids"):
            slots[name][at] = pdf[name].to_numpy()
        row = [pdf["bucket"].iloc[0], len(keys), hashed.displacements.tobytes(), slots.tobytes()]
        return pd.DataFrame([row], columns=["bucket", "n", "displacements", "slots"])

    runs = digests.groupBy("key", "shard", F.col("run_offset").alias("offset")).agg(F.sum("n_ids").alias("n_ids"))
    keyed = runs.select("*", bucket_of("key", buckets))
    schema = "bucket long, n long, displacements binary, slots binary"
    return pin(keyed.groupBy("bucket").applyInPandas(run, schema), "id-index")


def lookup(keys: DataFrame, store: IdStore) -> DataFrame:
    """key, shard, offset, n_ids for the keys (`key` long) that the index holds.

    A key that was never stored is found with a chance of one in four billion, the width
    of the fingerprint. Repeated keys are answered once each.
    """

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("key", "shard", "offset", "n_ids")})
        row = held.iloc[0]
        wanted = asked["key"].to_numpy()
        hashed = PerfectHash(int(row["n"]), np.frombuffer(row["displacements"], "<i8"))
        found = np.frombuffer(row["slots"], SLOT)[hashed.slots(wanted)]
        good = found["fingerprint"] == key_fingerprint(wanted)
        columns = {n: found[n][good].astype(np.int64) for n in ("shard", "offset", "n_ids")}
        return pd.DataFrame({"key": wanted[good], **columns})

    asked = keys.select("key").distinct().select("key", bucket_of("key", store.buckets))
    both = asked.groupBy("bucket").cogroup(store.index.groupBy("bucket"))
    return both.applyInPandas(run, "key long, shard long, offset long, n_ids long")


def store_ids(docs: DataFrame, path: str | None = None, shard_text_bytes: int = SHARD_TEXT_BYTES) -> IdStore:
    """Encodes `docs` (doc_id, text), writes shards to the shared folder and indexes them.

    A null text is empty, hence the end id alone. Rows with one doc_id lie side by side
    and are one entry of the index; rows without doc_id share one entry. Other columns
    are not read. An empty table makes a store without entries.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    folder = scratch_path(spark, "id-shards")
    width = write_shards(docs, folder, path, shard_text_bytes)
    digests = read_digests(spark, folder)
    buckets = max(1, -(-digests.count() // BUCKET_KEYS))
    return IdStore(folder, width, build_index(digests, buckets), digests, buckets)


def fetch(keys: DataFrame, store: IdStore) -> DataFrame:
    """key and ids (array<long>, end ids included) of the keys that are stored.

    The places asked for go to their shards; only those of one shard meet in a task.
    """
    spark = keys.sparkSession
    places = lookup(keys, store).groupBy("shard").agg(F.collect_list(F.struct("key", "offset", "n_ids")).alias("places"))
    places = pin(places, "id-places")
    own = _one_file_at_a_time(spark)
    number = F.regexp_extract(F.col("path"), r"part-(\d+)", 1).cast("long")
    files = own.read.format("binaryFile").load(store.path).select(number.alias("file"), "content")
    asked = own.read.schema(places.schema).parquet(places.inputFiles()[0].rsplit("/", 1)[0]) if not places.isEmpty() else None
    if asked is None:
        return spark.createDataFrame([], "key long, ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column("content"), batch.column("places").to_pylist()):
                ids = parse_shard(content.as_buffer().to_pybytes())[3]
                got = [ids[p["offset"] : p["offset"] + p["n_ids"]].astype(np.int64) for p in wanted]
                yield pa.record_batch([pa.array([p["key"] for p in wanted]), pa.array(got, pa.list_(pa.int64()))], names=["key", "ids"])

    joined = files.join(asked, F.col("file") == F.col("shard")).select("content", "places")
    return pin(joined.mapInArrow(run, "key long, ids array<long>"), "id-fetched")


def documents_in(store: IdStore, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents with these keys (`key`), found
    through the index and computed from the files that were read back.

    `start` counts the ids of all documents before it, over all shards.
    """
    totals = store.digests.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    found = lookup(keys, store).select("key", F.col("shard").alias("_at"), F.col("offset").alias("_run"))
    rows = store.digests.drop("key").join(found, (F.col("shard") == F.col("_at")) & (F.col("run_offset") == F.col("_run")))
    rows = rows.join(bases, F.col("shard") == F.col("_shard"))
    return rows.select(
        F.when(F.col("key") != NO_KEY, F.col("key")).alias("doc_id"),
        (F.col("base") + F.col("offset")).alias("start"),
        F.col("n_ids").alias("n_tokens"),
        "ids_crc32",
    )
