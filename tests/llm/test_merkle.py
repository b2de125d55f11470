"""The Merkle manifest against a plain Python tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakewright.llm import merkle
from lakewright.llm.merkle import fold, leaf, manifest, proof


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        first = at // 3 * 3
        path.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return path


def brute(rows):
    """(doc_id, text, leaf, subroot, root, path) of rows (doc_id, text, source)."""
    groups = {}
    for doc_id, text, source in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf_of([doc_id, source, text]), text))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: r[:3])
        trees[source] = levels_of([r[2] for r in groups[source]])
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for n, source in enumerate(order):
        for at, (has, doc_id, own, text) in enumerate(groups[source]):
            path = path_of(trees[source], at) + path_of(top, n)
            out.append((doc_id if has else None, text, own, trees[source][-1][0], top[-1][0], path))
    return out


def build(docs):
    values = [F.col("doc_id"), F.col("source"), F.col("text")]
    return manifest(docs, values, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "text": F.col("text")})


def rows_of(spread, seed=1):
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for source, count in spread.items():
        for _ in range(count):
            rows.append((doc_id, rng.choice(["a\nb", "", None, "plain", "ü\n"]) , source))
            doc_id += 1
    rng.shuffle(rows)
    return rows


CASES = [
    {"one": 1},
    {"one": 1, None: 1},
    {"a": 3, "b": 4, "": 2, None: 10, "ä": 28},
    {"hot": 200, **{f"s{i}": 1 + i % 7 for i in range(40)}},
]


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("spread", CASES)
def test_matches_plain_trees(frame, monkeypatch, spread, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rows = rows_of(spread)
    docs = frame(rows, "doc_id bigint, text string, source string, g string, pos int, path string, _part int")
    got = [(r.doc_id, r.text, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in build(docs).leaves.collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_a_changed_leaf_does_not_fold_to_the_root(frame):
    rows = rows_of({"a": 30, "b": 5, None: 1}, seed=2)
    docs = frame(rows, "doc_id bigint, text string, source string")
    cut = [F.col("doc_id"), F.col("source"), F.replace("text", F.lit("\n"), F.lit(""))]
    checked = build(docs).leaves.join(docs.select("doc_id", "source"), "doc_id").select(
        "text", "root", "leaf", fold(F.col("leaf"), F.col("path")).alias("own"), fold(leaf(cut), F.col("path")).alias("cut"),
        F.sha2(proof(F.col("path")), 256).alias("proof"), "path",
    )
    for r in checked.collect():
        assert r.own == r.root
        assert (r.cut == r.root) == (r.text is None or "\n" not in r.text)
        assert r.proof == digest("".join(s.before + s.after for s in r.path))


def test_repeated_rows_null_ids_long_texts_and_no_rows(spark, frame):
    rows = [(None, "x", "s")] * 7 + [(4, "y", "s"), (4, "x", "s"), (4, "y", "s"), (5, "long " * 100000, "s"), (None, None, None)]
    docs = frame(rows, "doc_id bigint, text string, source string")
    got = [(r.doc_id, r.text, r.leaf, r.subroot, r.root) for r in build(docs).leaves.collect()]
    assert sorted(got, key=repr) == sorted([b[:5] for b in brute(rows)], key=repr)
    empty = build(docs.limit(0))
    assert empty.leaves.count() == 0 and empty.subroots.count() == 0
    assert sorted((r.group or "", r.n) for r in build(docs).subroots.collect()) == [("", 1), ("s", 11)]


def test_crc_is_that_of_decimal_ids(spark):
    found = spark.range(50).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in found)
