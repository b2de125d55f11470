"""The pipeline's stages against plain Python, and the registered queries on the smallest tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakewright.llm import pii, similar
from lakewright.llm.queries import ORACLES, QUERIES
from lakewright.llm.tokens import encode, vocabulary_path
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SYLLABLES = {"aa": ["ba", "ka", "lu", "mi", "so"], "bb": ["sch", "ung", "ein", "der", "tz"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = []
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randrange(20, 90))
        if i % 6 == 0:
            text += f" write to user{i}@mail.example.com or call +1 (555) 201-{1000 + i}"
        made.append((i, text, lang if i % 4 else None, f"s{i % 5}", len(text)))
    made += [(200 + i, made[i][1], made[i][2], made[i][3], made[i][4]) for i in range(10)]
    return made + [(300, None, "aa", "s1", None), (301, "", None, None, 0), (302, "12 34 !!", "bb", "s0", 8), (None, made[50][1], None, None, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _found int, _copy string, fp int, key string"
    return spark.createDataFrame([r + (1, "x", 2, "k") for r in rows], schema).repartition(3).cache()


def run(spark, name, docs):
    return corpus_pipeline.pin(STAGES[name](spark, docs, FOLDER), name)


def test_stages_stand_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "pii", "mixing", "packing"]


def test_every_stage_decides_as_plain_python_does(spark, docs, rows):
    kept = run(spark, "language_id", docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r in rows} - {300, 301, 302}
    truth = {r[0]: r[2] for r in rows if r[2]}
    assert all(r.lang == truth[r.doc_id] for r in kept.collect() if r.doc_id in truth)

    single = run(spark, "simhash_near_dedup", kept)
    sets = {r.doc_id: similar.shingle_set(r.text) for r in kept.collect() if r.doc_id is not None}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min(root[j] for j in sets if similar.similarity(sets[i], sets[j]) >= 0.8) for i in sets}
    assert len(set(root.values())) < len(sets)
    assert {r.doc_id for r in single.collect()} == {i for i in sets if root[i] == i} | {None}

    clean = run(spark, "pii", single)
    before, after = ({r.doc_id: r for r in df.collect()} for df in (single, clean))
    assert before.keys() == after.keys()
    for i, row in before.items():
        if not pii.base_spans(row.text):
            assert after[i].text == row.text
        assert pii.base_spans(after[i].text) == [] and after[i].n_chars == len(after[i].text)
    assert any("<EMAIL>" in r.text for r in after.values())

    mixed = run(spark, "mixing", clean)
    assert mixed.columns == docs.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= set(after) and max(taken.values()) <= 3
    words = {i: len(r.text.split()) for i, r in after.items()}
    assert abs(sum(words[i] * n for i, n in taken.items()) - sum(words.values())) <= 0.1 * sum(words.values())

    packed = run(spark, "packing", mixed).collect()
    ids_of = {i: len(next(encode([r.text], vocabulary_path()))) + 1 for i, r in after.items()}
    held = Counter()
    for r in packed:
        held[r.doc_id] += r.length
    assert held == {i: ids_of[i] * n for i, n in taken.items()}
    total = Counter()
    for r in packed:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 1024


def test_dedup_stage_links_five_word_similarity_from_eight_tenths(spark):
    rng = random.Random(7)
    made, near, far = [], set(), set()
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        made.append((i, " ".join(words)))
        close, distant = list(words), list(words)
        for at in rng.sample(range(0, 300, 12), 1 + i % 5):
            close[at] = "changed"
        for at in range(0, 300, 25):
            distant[at] = "changed"
        made += [(1000 + i, " ".join(close)), (2000 + i, " ".join(distant))]
        near.add(1000 + i)
        far.add(2000 + i)
    group = [f"g{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(150):
        group[i % 200] = f"n{i}"
        made.append((5000 + i, " ".join(group)))
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in run(spark, "simhash_near_dedup", docs.repartition(5)).collect()}
    assert not kept & near
    assert far <= kept and set(range(60)) <= kept
    assert {i for i in kept if i >= 5000} == {5000}


def test_stages_take_an_empty_table(spark, docs):
    empty = docs.limit(0)
    for name in STAGES:
        assert run(spark, name, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


def test_queries_answer_for_every_document(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    for name in ("op1_binary_ids", "op3_simhash", "op4_language", "op6_mixing"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()) == ids, name


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_approximate_query_finds_nine_in_ten(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    vectors = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in QUERIES["op7_ann"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in ids[ids % 20 == 0]:
        score = vectors @ vectors[ids == q][0]
        order = [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        shares.append(len(found[q] & set(order)) / 20)
    print(folder, "mean", np.mean(shares), "worst", min(shares))
    assert np.mean(shares) >= 0.97 and min(shares) >= 0.8


def test_columns_may_clash_with_internal_names(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name in ("language_id", "simhash_near_dedup", "pii", "mixing"):
        with_more, without = run(spark, name, docs), run(spark, name, plain)
        assert with_more.columns == docs.columns and without.columns == plain.columns
        assert sorted(with_more.select("doc_id", "text", "lang").collect(), key=repr) == sorted(without.select("doc_id", "text", "lang").collect(), key=repr)
        assert with_more.where("_found = 1 and _copy = 'x' and fp = 2 and key = 'k'").count() == without.count()
