"""Near-duplicates by word shingles against exact components."""

import random

import pytest

from lakewright.llm import similar
from lakewright.llm.simhash import fingerprint
from lakewright.llm.similar import shingle_set, similar_documents, similarity


def exact(rows, least=0.8):
    """The smallest doc_id of each row's component, by all pairs."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    ids = {r: min([d for d in ds if d is not None], default=None) for r, ds in members.items()}
    return sorted([(doc_id, ids[find(i)]) for i, (doc_id, _) in enumerate(rows)], key=repr)


def answer(frame, rows):
    docs = frame(rows, "doc_id bigint, text string, tid string, keys int, u int, n string")
    return sorted([(r.doc_id, r.component_id) for r in similar_documents(docs).collect()], key=repr)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_null_empty_short_long_repeated_and_missing(frame):
    rng = random.Random(1)
    long = words(rng, 60000)
    near = list(long)
    near[30000] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one three"), (None, "one two"), (None, "alone here")]
    rows += [(8, " ".join(long)), (9, " ".join(near)), (4, "one two"), (4, "another text with the same id as others"), (10, " "), (11, "é " * 9)]
    assert answer(frame, rows) == exact(rows)


def test_no_rows(frame):
    docs = frame([(1, "x")]).limit(0)
    assert similar_documents(docs).count() == 0


@pytest.mark.parametrize("lot", [2, 256])
def test_a_large_group_whose_members_are_not_all_close(frame, monkeypatch, lot):
    monkeypatch.setattr(similar, "LOT", lot)
    rng = random.Random(2)
    rows, current = [], words(rng, 120)
    for i in range(400):
        current = list(current)
        current[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(current)))
    base = words(rng, 150)
    for i in range(300):
        copy = list(base)
        copy[i % 150] = f"c{i}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000 + i, " ".join(words(rng, 100))) for i in range(50)]
    got, want = dict(answer(frame, rows)), dict(exact(rows))
    assert len({want[i] for i in range(400)}) < 400
    assert got == want


def test_fingerprints_link_what_similarity_leaves_apart(frame):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = words(rng, 200)
        rows.append((i, " ".join(text)))
        text[100] = text[101] = f"x{i}"
        rows.append((100 + i, " ".join(text)))
    close = {(a, b): bin(fingerprint(s) ^ fingerprint(t)).count("1") <= 2 for a, s in rows for b, t in rows if a < b}
    docs = frame(rows)
    got = {r.doc_id: r.component_id for r in similar_documents(docs, least=1.0, radius=2).collect()}
    assert any(close.values())
    assert {pair for pair, near in close.items() if near} <= {(a, b) for a, b in close if got[a] == got[b]}
    assert {r.component_id for r in similar_documents(docs, least=1.0).collect()} == {d for d, _ in rows}


def test_only_texts_of_pairs_are_shuffled_and_no_pair_is_checked_twice(frame, settings, monkeypatch):
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40))) for i in range(200)]
    for i in range(30):
        text = words(rng, 100)
        close, distant = list(text), list(text)
        close[50] = distant[20] = distant[50] = distant[80] = "changed"
        rows += [(1000 + i, " ".join(text)), (2000 + i, " ".join(close)), (3000 + i, " ".join(distant))]
    plans, looked, pin, verified = [], [], similar.pin, similar.verified

    def noting(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return pin(df, name)

    def counting(texts, pairs, *more):
        looked.extend((r.u, r.v) for r in pairs.collect())
        return verified(texts, pairs, *more)

    monkeypatch.setattr(similar, "pin", noting)
    monkeypatch.setattr(similar, "verified", counting)
    assert answer(frame, rows) == exact(rows)
    assert not [p for p in plans if "LeftSemi" in p]
    assert len(looked) > 30 and len(looked) == len(set(looked))


def test_texts_of_pairs_are_whole_whatever_the_filter_lets_through(frame):
    docs = frame([(i, f"text {i % 500}") for i in range(2000)] + [(None, None), (3000, "")])
    tids = {r.tid: r.text for r in similar.numbered(docs).collect()}
    ends = sorted(tids)[:20]
    pairs = docs.sparkSession.createDataFrame(list(zip(ends[::2], ends[1::2])), "u long, v long")
    for bits in (64, similar.FILTER_BITS):
        got = [(r.tid, r.text) for r in similar.texts_of(docs, pairs, bits).collect()]
        assert len(got) == len(dict(got)) and set(ends) <= dict(got).keys() and dict(got).items() <= tids.items()
    assert len(got) < 40
    assert similar.texts_of(docs, pairs.limit(0)).count() == 0
