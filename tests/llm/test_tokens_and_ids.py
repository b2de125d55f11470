"""Token cache, binary shards, perfect hash index and packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakewright.llm import binary_ids, packing
from lakewright.llm.tokens import encode, vocabulary_path

AWKWARD = ["", " ", "  a", "a b", "a  b\n c", "don't  stop", "x" * 5000, "日本語 テスト", "café, naïve. 12²", "a \tb", "\x01odd", "end\nof. line"]
AWKWARD += ["A, b; c.\nD", "a,\n\nb", "a.\n b", "\x02, a", "x_, y", ". a.\n", "it's, 'tis", "12. 3,\n4", "a.b. c", "\n.\na"]


def whole(texts):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_cached_ids_are_those_of_whole_texts():
    rng = random.Random(1)
    letters = "ab é日'’s.,!?_-\n\t  12²ⅧÄ́ \x01\x02\x85%*;:"
    texts = AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert [x.tolist() for x in encode(texts, vocabulary_path())] == whole(texts)
    assert next(encode([None], vocabulary_path())).tolist() == []


def test_added_tokens_in_a_text_have_their_own_ids(frame):
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b c.", "half <|endof text|> two", "<|ENDOFTEXT|> x", "one two"]
    assert [x.tolist() for x in encode(texts, vocabulary_path())] == whole(texts)
    assert 50256 in whole(texts)[0]
    docs = frame(list(enumerate(texts)))
    starts = {r.doc_id: (r.start, r.n_tokens) for r in binary_ids.documents_in(binary_ids.store_ids(docs), docs.select(F.col("doc_id").alias("key"))).collect()}
    assert [starts[i][1] for i in range(len(texts))] == [len(ids) + 1 for ids in whole(texts)]
    pieces = {r.doc_id: r.ids_crc32 for r in packing.pack(docs).collect()}
    assert pieces == {i: zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for i, ids in enumerate(whole(texts))}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
    keys = np.unique(np.concatenate([keys, np.arange(min(n, 3))]))[:n]
    if n:
        assert sorted(binary_ids.PerfectHash.build(keys).slots(keys).tolist()) == list(range(n))


def test_ids_come_back_from_files_and_index(spark, frame):
    texts = AWKWARD + [None, "same text", "same text"]
    docs = frame([(i * 7 - 3, t) for i, t in enumerate(texts)])
    store = binary_ids.store_ids(docs, shard_text_bytes=3000)
    assert store.digests.select("shard").distinct().count() > 1
    keys = docs.select(F.col("doc_id").alias("key"))
    got = {r.doc_id: r for r in binary_ids.documents_in(store, keys).collect()}
    start = 0
    for i, ids in enumerate(whole(texts)):
        ids = [*ids, 0]
        row = got[i * 7 - 3]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc), i
        start += len(ids)
    wanted = keys.where("key > 0").unionByName(spark.range(1).select(F.lit(10**12).alias("key")))
    fetched = {r.key: r.ids for r in binary_ids.fetch(wanted, store).collect()}
    assert fetched == {i * 7 - 3: [*ids, 0] for i, ids in enumerate(whole(texts)) if i * 7 - 3 > 0}


def test_rows_that_share_an_id_or_have_none_stay(frame):
    docs = frame([(1, "one"), (1, "two"), (None, "three"), (None, None)])
    keys = docs.select(F.coalesce("doc_id", F.lit(binary_ids.NO_KEY)).alias("key"))
    rows = binary_ids.documents_in(binary_ids.store_ids(docs), keys).collect()
    assert sorted(r.doc_id is None for r in rows) == [False, False, True, True]
    assert sorted(r.start for r in rows) == [0, 1, *sorted(r.start for r in rows)[2:]]


def test_an_empty_table_has_no_ids(frame):
    docs = frame([])
    store = binary_ids.store_ids(docs)
    assert binary_ids.documents_in(store, docs.select(F.col("doc_id").alias("key"))).count() == 0


def check_packing(rows, texts, limits):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, ids in texts.items():
        ids = np.array([*ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        assert sum(r.length for r in held) <= limits.tokens and len(held) <= limits.segments
        assert sum(r.loss for r in held) <= limits.loss
    return sequences


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(100, 50, 40)])
def test_every_id_lies_in_one_piece_within_all_limits(frame, limits):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["alpha", "be", "gammagamma"]) for _ in range(rng.randrange(400))) for i in range(60)}
    texts |= {1000 + i: t for i, t in enumerate(AWKWARD)}
    docs = frame([*texts.items(), (2000, None)], parts=2)
    rows = packing.pack(docs, limits).collect()
    ids = dict(zip([*texts, 2000], whole([*texts.values(), None])))
    sequences = check_packing(rows, ids, limits)
    if limits == packing.Limits():
        short = [s for s in sequences.values() if sum(r.length for r in s) < limits.tokens]
        assert len(short) <= 2


def test_loss_marks_bound_a_sequence(spark):
    rng = random.Random(9)
    talks = [(i, ids := [rng.randrange(50_000) for _ in range(rng.randrange(1, 90))], [rng.randrange(2) for _ in ids]) for i in range(80)]
    df = spark.createDataFrame(talks + [(500, None, None), (501, [], [])], "conv bigint, ids array<int>, marks array<int>").repartition(2)
    limits = packing.Limits(128, 4, 50)
    rows = packing.pack_marked(df, "conv", "ids", "marks", limits).collect()
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids, _ in talks)
    assert sum(r.loss for r in rows) == sum(map(sum, (m for _, _, m in talks)))
    held = {}
    for r in rows:
        n, k, loss = held.get(r.sequence_id, (0, 0, 0))
        held[r.sequence_id] = (n + r.length, k + 1, loss + r.loss)
    assert all(n <= 128 and k <= 4 and loss <= 50 for n, k, loss in held.values())


def test_repeated_rows_and_an_empty_table_are_packed(frame):
    assert packing.pack(frame([])).count() == 0
    rows = packing.pack(frame([(1, "a"), (1, "a"), (None, "b")], parts=1)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 2), (1, 2)]


def test_padding_is_none_at_powers_of_two(spark):
    df = spark.createDataFrame([(1,), (1000,), (512,), (1024,)], "n bigint")
    assert [r[0] for r in df.select(packing.padding(F.col("n"))).collect()] == [0, 24, 0, 0]
