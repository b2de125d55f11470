"""Ranked search against plain Python."""

import math
import random
import re

import pytest

from lakewright.llm import ranked
from lakewright.llm.ranked import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(doc_id, terms(text)) for doc_id, text in docs]
    held = [(doc_id, words) for doc_id, words in held if words]
    n, total = len(held), sum(len(words) for _, words in held)
    df = {}
    for _, words in held:
        for word in set(words):
            df[word] = df.get(word, 0) + 1
    weight = {word: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for word, d in df.items()}
    out = []
    for item_id, text in items:
        found = []
        for doc_id, words in held:
            m = 100 - 75 + 75 * len(words) * n // total
            score = sum(weight.get(t, 0) * (1000000000 * words.count(t) // (1000 * words.count(t) + 8 * m)) for t in terms(text))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def answer(spark, docs, items, k=10, parts=3):
    left = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, item string, score int").repartition(parts)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    return sorted(map(tuple, ranked_search(left, right, k).collect()), key=repr)


def words(rng, n, size):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % n}" for _ in range(size))


@pytest.mark.parametrize("block_bytes,few,lots", [(4 << 20, 12, 16), (4000, 1, 4), (1, 12, 2), (2000, 0, 1)])
def test_matches_brute_force(spark, monkeypatch, block_bytes, few, lots):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(ranked, "FEW", few)
    monkeypatch.setattr(ranked, "LOTS", lots)
    rng = random.Random(3)
    docs = [(i, words(rng, 400, rng.randrange(1, 60))) for i in range(250)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)]
    rng.shuffle(docs)
    items = [(i, words(rng, 400, rng.randrange(1, 30))) for i in range(12)] + [(90, docs[0][1]), (91, "w1"), (92, "w1 w1 w2")]
    assert answer(spark, docs, items) == brute(docs, items)


def test_terms_cases_and_letters(spark):
    docs = [(1, "Straße ÉCOLE naïve"), (2, "straße école NAÏVE"), (3, "a_b-c`d{e}f\x7fg"), (4, "x\x00y\x01Z9"), (5, "  　")]
    items = [(1, "STRAßE École"), (2, "A B g"), (3, "z9 X"), (4, " "), (5, "nothing of it")]
    assert answer(spark, docs, items) == brute(docs, items)


def test_nulls_ties_repeats_long_texts_and_no_rows(spark):
    docs = [(None, "apple pear"), (5, "apple pear"), (4, "apple pear"), (4, "apple pear"), (6, None), (7, ""), (8, " .,"), (9, "pear " * 200000), (10, "fig")]
    items = [(1, "apple"), (1, "apple"), (None, "pear fig"), (2, None), (3, ""), (4, "...")]
    assert answer(spark, docs, items, k=3) == brute(docs, items, k=3)
    assert answer(spark, docs, items, k=20, parts=1) == brute(docs, items, k=20)
    assert answer(spark, [], items) == [] and answer(spark, docs, []) == [] and answer(spark, [(1, None)], items) == []


def test_items_go_through_in_passes(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_BYTES", 200)
    rng = random.Random(4)
    docs = [(i, words(rng, 100, 20)) for i in range(60)]
    items = [(i, words(rng, 100, 8)) for i in range(20)]
    assert answer(spark, docs, items) == brute(docs, items)


def test_a_group_is_only_scored_while_it_can_reach_the_best(spark, monkeypatch):
    scored = []
    own = ranked.Block.scores

    def counted(self, docs, places, factors):
        scored.append(len(docs))
        return own(self, docs, places, factors)

    monkeypatch.setattr(ranked.Block, "scores", counted)
    rng = random.Random(5)
    texts = [("rare " if i % 100 == 0 else "") + "common " * rng.randrange(1, 4) + "other" for i in range(2000)]
    number = {b"common": 0, b"other": 1, b"rare": 2}
    import numpy as np

    counts = [[t.split().count(w.decode()) for t in texts] for w in number]
    row = {
        "doc_ids": np.arange(2000), "sizes": np.array([len(t.split()) for t in texts]), "terms": np.array([0, 1, 2]),
        "held": np.array([sum(c > 0 for c in cs) for cs in counts]),
        "docs": np.concatenate([[i for i, c in enumerate(cs) if c] for cs in counts]),
        "times": np.concatenate([[c for c in cs if c] for cs in counts]),
    }
    asked = ranked.Asked([], np.array([10, 10, 4000]), 2000, int(row["sizes"].sum()))
    best = []
    ranked.Block(row, asked).search(np.array([0, 1, 2]), np.array([10, 10, 4000]), best, 10, 1)
    assert len(best) == 10 and all(-d % 100 == 0 for _, d in best)
    assert sum(scored) <= 40
