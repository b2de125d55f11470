"""Near-duplicates, repeats, mixing, language, personal data and licences against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakewright.llm import language, licences, mixing, pii, repeats, simhash
from lakewright.llm.components import connected_components


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def slow_fingerprint(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(links + [(None, 5), (7, 7)], "u bigint, v bigint").repartition(4)
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = roots_of([x for x in links if x[0] != x[1]], got)
    together = defaultdict(set)
    for n, root in got.items():
        together[root].add(want[n])
    assert all(len(x) == 1 for x in together.values()) and len(together) == len(set(want.values()))
    assert connected_components(df.limit(0)).count() == 0


def test_simhash_links_and_components_match_brute_force(frame):
    rng = random.Random(3)
    texts = {}
    for i in range(40):
        base = words(rng, rng.choice([0, 1, 2, 5, 60, 300]))
        for k in range(rng.randrange(1, 5)):
            tokens = base.split()
            if tokens and k:
                tokens[rng.randrange(len(tokens))] = "Changed"
            texts[len(texts) * 3] = " ".join(tokens) if k % 2 else base
    texts[999], texts[1000] = None, "\t \n"
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(list(texts.items()))).collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    links = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in got.items()} == roots_of(links, texts)


def test_ball_hashing_finds_every_pair_within_two_bits(spark):
    rng = random.Random(8)
    centre = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(12)} | set(centre)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = [(r.u, r.v) for r in simhash.ball_links(df).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert roots_of(found, signed) == roots_of(links, signed)


def test_one_document_of_each_group_stays(frame):
    docs = frame([(5, "a b c d"), (2, "a b c d"), (9, "other words here now"), (None, "a b c d"), (7, "x y z"), (7, "x y z")])
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 9]
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(frame([])).count() == 0


def slow_repeats(texts, length, keep_first):
    places = defaultdict(list)
    for key in sorted(texts):
        data = (texts[key] or "").encode()
        for i in range(len(data) - length + 1):
            places[data[i : i + length]].append((key, i))
    result = {}
    for key, text in texts.items():
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            at = places[data[i : i + length]]
            if len(at) > 1 and (not keep_first or at[0] != (key, i)):
                gone |= set(range(i, i + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        result[key] = (len(data), len(gone), spans, bytes(b for i, b in enumerate(data) if i not in gone))
    return result


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("group_runs, bits", [(512, 1 << 16), (1, 1 << 16), (512, 64)])
def test_repeats_match_brute_force(frame, keep_first, group_runs, bits, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(6)
    passage = [words(rng, 30) for _ in range(4)]
    texts = {}
    for i in range(30):
        parts = [rng.choice(passage) if rng.random() < 0.4 else words(rng, rng.randrange(12), 10_000) for _ in range(rng.randrange(5))]
        texts[i] = "é ".join(parts)
    texts |= {40: "ab" * 400, 41: texts[3], 42: None, 43: "short", 44: "long " * 500}
    got = repeats.remove_repeats(frame(list(texts.items())), 40, 16, keep_first, bits, group_runs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == slow_repeats(texts, 40, keep_first)


def test_repeats_of_rows_without_own_ids(frame):
    text = words(random.Random(1), 60)
    rows = repeats.remove_repeats(frame([(1, text), (1, "x" + words(random.Random(2), 60)), (None, text)]), 40, 16, filter_bits=1 << 16).collect()
    assert sorted(r.n_removed for r in rows) == [0, len(text), len(text)]
    assert repeats.remove_repeats(frame([]), filter_bits=1 << 16).count() == 0


def test_longest_previous_factors_match_brute_force():
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))
        order = sorted(range(len(text)), key=lambda i: text[i:])

        def shared(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        common = [0, *[shared(a, b) for a, b in zip(order, order[1:])]]
        best = repeats.longest_previous_factors(order, common)
        assert best == [max([shared(i, j) for j in range(i)], default=0) for i in order]


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_names = sum(sizes.values()), {}, set(names)
    while open_names:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_names)
        over = {s for s in open_names if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_names}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_names -= over
    return target


@pytest.mark.parametrize("block", [50, 4096])
def test_mix_comes_near_its_targets(frame, block):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        source = rng.choice([None, "a", "b", "c", "d", "e"] + ["hot"] * 6) if i > 3 else "tiny"
        rows.append((i, words(rng, rng.choice([0, 3, 40, 90])) if i % 50 else None, None, source))
    docs = frame(rows)
    got = mixing.mix(docs, block_rows=block).collect()
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    sizes = Counter()
    for i, _, _, s in rows:
        sizes[s] += size[i]
    targets, taken = slow_targets(sizes), Counter()
    assert len(got) == 900 and {r.doc_id: r.size for r in got} == size
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 45, s
    again = mixing.mix(docs.repartition(7), block_rows=block).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_taking_a_mix_repeats_rows(frame):
    docs = frame([(i, "one two", "en", "s", 7) for i in range(4)] + [(9, None, None, "t", None)])
    mixed = mixing.mix(docs)
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixed.collect() if r.copies}
    assert {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()} == want
    assert mixing.mix(frame([])).count() == 0


def test_equal_rows_are_units_of_their_own(frame):
    copies = [(7, "one two three", "en", "s", 13)] * 500 + [(None, "four five", "en", "s", 9)] * 300
    docs = frame(copies + [(100 + i, f"a{i} " * (1 + i % 9), "en", "tu"[i % 2], i) for i in range(400)])
    mixed = mixing.mix(docs, block_rows=64)
    rows = mixed.collect()
    assert len(rows) == 1200 and sum(r.doc_id == 7 for r in rows) == 500
    for s in "stu":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    taken = Counter(r.doc_id for r in mixing.take(docs, mixed).collect())
    assert taken == +want


def test_equal_rows_share_their_copies_by_other_columns(frame):
    docs = frame([(1, "a b", "x", "s", 1)] * 3 + [(1, "a b", "y", "s", 2)] * 4 + [(2, "c", "x", "s", 3)])
    mixed = docs.selectExpr("doc_id", "xxhash64(text) AS text_key", "CASE WHEN doc_id = 2 THEN 0L WHEN lang = 'x' THEN 2L ELSE 1L END AS copies")
    taken = Counter(r.lang for r in mixing.take(docs, mixed).collect())
    assert sum(taken.values()) == 10 and 3 <= taken["x"] <= 6 and 4 <= taken["y"] <= 7
    assert mixing.take(docs.limit(0), mixed).count() == 0


def test_large_documents_do_not_keep_a_source_from_its_target():
    rng = np.random.default_rng(5)
    for trial in range(20):
        size = np.concatenate([rng.integers(1, 60, 400), [6000, 5000, 900]])
        prob = np.full(len(size), 0.05 + 0.04 * trial)
        settled = mixing.settle(prob, size, trial)
        assert set(settled) <= {0.0, 1.0} and abs(settled @ size - prob @ size) <= 2
    assert len(mixing.settle(np.empty(0), np.empty(0), 1)) == 0


def test_flight_keeps_sums_and_leaves_few():
    rng = np.random.default_rng(1)
    size, prob = rng.integers(0, 500, 300), np.full(300, 0.37)
    after = mixing.flight(prob, size, 3)
    open_units = ((after > 0) & (after < 1)).sum()
    assert open_units <= mixing.LANDING
    assert after.sum() == pytest.approx(prob.sum()) and after @ size == pytest.approx(prob @ size)
    landed = mixing.land(after, size)
    assert set(landed) <= {0.0, 1.0}


LANGUAGES = {"aa": ["ba", "ka", "lu", "mi"], "bb": ["sch", "ung", "ein", "der"], "cc": ["tion", "eau", "que", "oi"]}


def labelled(rng, n, start=0):
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        text = " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 40)))
        rows.append((start + i, text, lang))
    return rows


def slow_kneser_ney(counts, order, context, letter):
    """The same model by the textbook formula over all counts of one language."""
    grams = dict(counts)
    levels = [grams]
    for _ in range(order - 1):
        lower = Counter(g[1:] for g in levels[0])
        levels.insert(0, dict(lower))
    chance = None
    for k, grams in enumerate(levels):
        discount = language._discount(np.array(list(grams.values())))
        h = context[len(context) - k :] if k else ""
        total = sum(n for g, n in grams.items() if g[:-1] == h)
        kinds = sum(1 for g in grams if g[:-1] == h)
        below = 1 / (len(grams) + 1) if k == 0 else chance
        chance = (max(grams.get(h + letter, 0) - discount, 0) + discount * kinds * below) / total if total else below
    return chance


def test_model_follows_interpolated_kneser_ney(frame):
    rows = labelled(random.Random(1), 60)
    counts = language.gram_counts(frame(rows), 3).toPandas()
    model = language.build_model(counts, 3)
    own = {g: int(n) for g, n in counts[counts["lang"] == "bb"][["gram", "n"]].itertuples(index=False)}
    word = "schx"
    want, padded = 0.0, language.BEGIN * 2 + word + language.END
    for i in range(2, len(padded)):
        want += np.log(slow_kneser_ney(own, 3, padded[i - 2 : i], padded[i]))
    assert model.word_scores([word])[0, model.languages.index("bb")] == pytest.approx(want)


def test_language_of_held_out_texts(spark, frame):
    rng = random.Random(2)
    model = language.train(frame(labelled(rng, 300)))
    asked = labelled(rng, 100, 1000)
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "жук жил у реки и пел свои песни о далёких странах")]
    docs = frame([*asked, *odd]).select("doc_id", language.identify(F.col("text"), model).alias("f"))
    got = {r.doc_id: r.f for r in docs.collect()}
    right = [got[i].lang_pred == lang for i, _, lang in asked]
    assert sum(right) >= 97 and sum(got[i].accepted for i, _, _ in asked) >= 98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3))
    assert got[4].lang_pred in LANGUAGES and not got[4].accepted
    assert all(0 <= f.score <= 1 for f in got.values())


def test_pruning_leaves_sums_discounts_and_every_language(frame):
    rng = random.Random(12)
    rows = labelled(rng, 200) + [(9000 + i, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40)), "flat") for i in range(8)]
    counts = language.gram_counts(frame(rows), 4).toPandas()
    plain = language.build_model(counts, 4)
    whole = language.spark_model(frame(rows).sparkSession.createDataFrame(counts), 4, 10**6, 0)
    assert whole.languages == plain.languages and np.allclose(whole.floor, plain.floor)
    for ours, theirs in zip(whole.levels, plain.levels):
        assert all(np.allclose(a.astype(float), b.astype(float)) for a, b in zip(ours, theirs))
    small = language.train(frame(rows), least_grams=60, growth=0)
    for (hashes, chance, _), (all_hashes, all_chance, _) in zip(small.levels, plain.levels):
        at = np.searchsorted(all_hashes, hashes)
        assert (all_hashes[at] == hashes).all()
        held = chance > 0
        assert np.allclose(chance[held], all_chance[at][held])
        assert (held.sum(axis=0) > 0).all()
    assert len(small.levels[3][0]) < len(plain.levels[3][0])
    assert max((chance > 0).sum(axis=0).max() for _, chance, _ in small.levels) < 120
    assert len(language.train(frame(rows)).levels[3][0]) == len(plain.levels[3][0])


def test_rejection_counts_every_labelled_text(frame):
    schema = "lang string, lang_pred string, entropy double, letters long"
    spark = frame([]).sparkSession
    texts = [("aa", "aa", 2.0 + i % 7 / 10, 40 + i % 90) for i in range(9000)]
    far = [("aa", "aa", 9.0, 100) for _ in range(60)]
    plain = language.calibrate(spark.createDataFrame(texts + far[:1], schema))
    moved = language.calibrate(spark.createDataFrame(texts + far, schema))
    own = np.array([r[2:] for r in texts + far])
    long_enough = own[:, 1] >= np.median(own[:, 1])
    mean, between = own[long_enough, 0].mean(), own[long_enough, 0].std()
    by_letter = ((own[:, 0] - mean) * np.sqrt(own[:, 1]))[~long_enough].std()
    assert moved.spreads["aa"] == pytest.approx((mean, max(between, 0.02), max(by_letter, 1.0)))
    excess = (own[:, 0] - mean) / np.sqrt(between**2 + max(by_letter, 1.0) ** 2 / own[:, 1] + 1e-9)
    assert moved.limit == pytest.approx(max(3.0, 3 * np.quantile(excess, 0.999, method="inverted_cdf")), abs=3 / language.STEPS)
    assert plain.limit < moved.limit


def test_one_scoring_gives_what_train_and_identify_give(frame):
    rng = random.Random(5)
    rows = [*labelled(rng, 120), (9001, None, "aa"), (9002, "", None), (9003, "123", "aa")]
    docs = frame(rows)
    learn = F.col("doc_id") % 3 != 0
    model = language.train(docs.where(learn))
    want = docs.select("doc_id", language.identify(F.col("text"), model).alias("f"))
    got = language.recognise(docs, learn, "f").select("doc_id", "f")
    key = lambda r: (r.doc_id, r.f.lang_pred, round(r.f.score, 9), r.f.accepted)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_language_without_labels_knows_none(frame):
    model = language.train(frame([(1, "text", None), (2, None, "aa")]))
    docs = frame([(1, "text")]).select(language.identify(F.col("text"), model).alias("f"))
    assert docs.first().f.lang_pred == "und"


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    letters = "ab1290@@.-+ ()"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        want = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
        want += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            want += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if pii.valid(kind, m.group())]
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1" * 50_000 + ".x") == []


def test_gradients_of_the_tagger():
    tagger = pii.Tagger.fresh(3, 2)
    rng = np.random.default_rng(0)
    chars, tags = rng.integers(0, pii.CLASSES, (2, 5)), rng.integers(0, pii.TAGS, (2, 5))
    _, grads = tagger.gradients(chars, tags)
    for name, values in tagger.p.items():
        at = tuple(int(rng.integers(n)) for n in values.shape)
        if name == "E":
            at = (int(chars[0, 0]), at[1])
        old, step = values[at], 1e-5
        values[at] = old + step
        high = tagger.gradients(chars, tags)[0]
        values[at] = old - step
        low = tagger.gradients(chars, tags)[0]
        values[at] = old
        assert grads[name][at] == pytest.approx((high - low) / (2 * step), abs=1e-6)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    tagger = pii.Tagger.fresh(3, 2)
    tagger.p["T"] = rng.normal(size=(pii.TAGS, pii.TAGS))
    scores = rng.normal(size=(2, 3, pii.TAGS))
    tags = tagger.decode(scores, np.array([3, 2]))
    grid = [(a, b, c) for a in range(pii.TAGS) for b in range(pii.TAGS) for c in range(pii.TAGS)]
    t = tagger.p["T"]
    best = max(grid, key=lambda p: scores[0, 0, p[0]] + scores[0, 1, p[1]] + scores[0, 2, p[2]] + t[p[0], p[1]] + t[p[1], p[2]])
    assert tuple(tags[0]) == best
    best = max(((a, b) for a in range(pii.TAGS) for b in range(pii.TAGS)), key=lambda p: scores[1, 0, p[0]] + scores[1, 1, p[1]] + t[p])
    assert tuple(tags[1, :2]) == best


def with_personal_data(rng, i):
    prose = words(rng, 12).replace("w", "wor").translate(str.maketrans("0123456789", "abcdefghij")).split()
    prose.insert(6, rng.choice([f"u{i}@mail{i % 7}.example.com", f"10.{i % 256}.3.{i % 99}", f"+1 (555) {200 + i % 700}-{1000 + i}", "4111 1111 1111 1111"]))
    return " ".join(prose)


def test_tagger_learns_and_base_spans_stay(frame):
    rng = random.Random(5)
    docs = frame([(i, with_personal_data(rng, i)) for i in range(260)])
    tagger = pii.train(docs, windows=240, epochs=24)
    asked = [(1000 + i, with_personal_data(rng, i * 3 + 1)) for i in range(80)] + [(1, None), (2, ""), (3, "no data here")]
    got = {r.doc_id: r.f for r in frame(asked).select("doc_id", pii.report(F.col("text"), tagger).alias("f")).collect()}
    for i, text in asked:
        base = pii.base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(base) <= set(pii.parse(got[i].spans))
        assert got[i].n_email == sum(k == "email" for k, _, _ in base)
    parts = [w for _, text in asked if text for w in pii.labelled_windows(text)]
    hit = wrong = missed = 0
    for scores, (part, spans) in zip(pii.region_scores(tagger, [p for p, _ in parts]), parts):
        found = set(pii.spans_of_tags(tagger.decode(scores[None], np.array([len(part)]))[0]))
        want = set(pii.parse(spans))
        hit, wrong, missed = hit + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert 2 * hit / (2 * hit + wrong + missed) > 0.7
    clean = frame([(1, "mail bob@mail.example.com or +1 (555) 201-1000"), (2, None)]).select("doc_id", pii.redacted(F.col("text"), tagger).alias("t"))
    assert {r.doc_id: r.t for r in clean.collect()} == {1: "mail <EMAIL> or <PHONE>", 2: None}


def test_windows_agree_where_they_overlap():
    tagger = pii.Tagger.fresh()
    text = "abc 12 " * 60
    (scores,) = pii.region_scores(tagger, [text])
    assert scores.shape == (len(text), pii.TAGS) and np.isfinite(scores).all()
    assert pii.regions("no digits") == []


def test_copies_of_a_window_count_once_in_training(frame, monkeypatch):
    seen = []
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, chars, tags, epochs: seen.append(chars) or self)
    texts = ["call +1 (555) 201-1000 now"] * 300 + [f"mail u{i}@mail.example.com soon" for i in range(40)] + ["room 12"] * 300 + [f"room {i}" for i in range(200, 240)]
    pii.train(frame([(i, t) for i, t in enumerate(texts)]).repartition(4), windows=60)
    (chars,) = seen
    assert len(chars) == len(np.unique(chars, axis=0)) == 60


def test_licences_are_named_and_other_lines_left_alone(frame):
    rng = random.Random(6)
    lines = {
        1: ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        2: ("Released under the MIT License.", "mit"),
        3: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        4: ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
        5: ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    }
    docs = [(i, f"{words(rng, 20)}\n{line}\n{words(rng, 5)}") for i, (line, _) in lines.items()]
    docs += [(i, words(rng, 30)) for i in range(10, 60)] + [(70, None), (71, ""), (72, "The version of the license was granted to the public.")]
    table = frame(docs + docs[:1])
    found = licences.scan(table, licences.train(table))
    got = sorted((r.doc_id, r.paragraph, r.family) for r in found.collect())
    assert got == sorted([(i, 1, family) for i, (_, family) in lines.items()] + [(1, 1, "apache-2.0")])
    assert all(r.probability > 0.5 and r.overlap >= 0.5 for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert licences.scan(frame([]), licences.train(table)).count() == 0


def test_background_lines_are_distinct_and_least_by_hash(spark, frame):
    texts = ["one line that is long enough\n" * 40, None, "", "\n".join(f"line number {i} of some text" for i in range(50))]
    lines = licences.paragraphs(frame(list(enumerate(texts)))).where(F.length("line").between(15, 2000))
    got = [r.line for r in licences.background_lines(lines, 20).collect()]
    every = {r.line: r.hash for r in lines.select("line", F.xxhash64("line").alias("hash")).collect()}
    assert len(every) == 51
    assert got == sorted(every, key=every.get)[:20]
    assert licences.background_lines(lines, 500).count() == 51
    assert licences.background_lines(lines.limit(0), 20).count() == 0


def test_licences_without_corpus(frame):
    model = licences.train(frame([]))
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    assert [r.doc_id for r in licences.scan(frame([(1, text), (2, "some other words in a row here")]), model).collect()] == [1]


@pytest.mark.parametrize("most", [0, 100])
def test_keep_one_sends_ids_instead_of_shuffling_texts(frame, settings, monkeypatch, most):
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    monkeypatch.setattr(simhash, "SENT_ROWS", most)
    docs = frame([(i, f"text {i}") for i in range(40)] + [(None, "no id")])
    classes = docs.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 4).alias("component_id"))
    kept = simhash.keep_one(docs, classes)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*range(0, 40, 4), None], key=repr)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert ("SortMergeJoin" in plan) == (most == 0) and ("BroadcastHashJoin" in plan) == (most > 0)
    docs = docs.unionByName(docs.where("doc_id < 5"))
    again = simhash.keep_one(docs, docs.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 4).alias("component_id")))
    assert sorted((r.doc_id for r in again.collect()), key=repr) == sorted([*range(0, 40, 4), None], key=repr)


def test_every_distinct_line_counts_in_licence_training(spark, frame):
    rng = random.Random(9)
    lines = [words(rng, 8) for _ in range(900)]
    for i in range(30):
        lines[i * 30] += " granted"
    lines += ["someone hereby said so"] * 60 + ["ok", "", " - ", "granted " + words(rng, 900)]
    rng.shuffle(lines)
    docs = frame([(i, "\n".join(lines[i::40])) for i in range(40)] + [(100, None)])
    sets = {tuple(r.grams): r.n for r in licences.background_sets(docs, {"granted", "hereby", "hereby granted"}).collect()}
    assert sets == {(): 871, ("granted",): 31, ("hereby",): 1}
    held = {x["gram"] for x in licences.train(docs, background=5).weights}
    assert "hereby" in held and "granted" not in held
