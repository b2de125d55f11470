"""Language identification by interpolated Kneser-Ney character models.

A text counts as its runs of letters, lower-cased. Each run, with begin marks before and
an end mark behind, is predicted letter by letter from the letters before it in the run;
the language is the one with the lowest cross-entropy per letter. One model holds all
languages: for each order the hashes of its n-grams, sorted, and beside them, by language,
the discounted probability of the n-gram and the weight that the n-gram as a context leaves
to the next lower order.

Counts, sums and discounts come from all n-grams of all labelled texts. Afterwards each
language keeps, of every order, its most frequent n-grams: `least_grams`, or `growth`
times the root of the letters seen if that is more. What is pruned goes to the lower order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import entering, free_name, pin, slices

BEGIN, END = "\x02", "\x03"
RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words whose scores a worker remembers, and n-grams it counts before it passes them on.
CACHE_WORDS = 300_000
HELD_GRAMS = 150_000
RESULT = "lang_pred string, score double, entropy double, letters long"
#: Steps of one unit of the excess in which texts are counted for the rejection.
STEPS = 1024


def letter_runs(text: str) -> list[str]:
    return RUN.findall(text.lower())


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of the `order` code points up to and with each place; the first ones, which
    lack some, are no n-grams."""
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * BASE
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(len(codes), np.uint64)
        for back in range(order):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[back:] = mixed[: len(codes) - back]
            total = total * np.uint64(0xBF58476D1CE4E5B9) + shifted
        total ^= total >> np.uint64(32)
        return total * np.uint64(0x94D049BB133111EB)


def text_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Usual:
    """What entropies are usual. `spreads`: for each language the mean entropy, the spread between texts and
    the spread by letter; `limit`: the largest excess over the mean, in units of these spreads, at
    which a text is accepted."""

    spreads: dict[str, tuple[float, float, float]]
    limit: float = float("inf")

    def excess(self, language: Column, entropy: Column, letters: Column) -> Column:
        """Null for a language without spreads."""
        if not self.spreads:
            return F.lit(None).cast("double")
        pairs = [x for lang, own in self.spreads.items() for x in (F.lit(lang), F.array(*map(F.lit, own)))]
        held = F.create_map(*pairs)
        mean, between, by_letter = (held[language][i] for i in range(3))
        wide = between * between + by_letter * by_letter / F.greatest(letters, F.lit(1)) + F.lit(1e-9)
        return (entropy - mean) / F.sqrt(wide)

    def accepts(self, found: Column) -> Column:
        """Whether the entropy in the struct `found`, as identify gives it, is usual; false for `und`."""
        far = self.excess(found["lang_pred"], found["entropy"], found["letters"])
        return (found["lang_pred"] != UNKNOWN) & (F.coalesce(far, F.lit(0.0)) <= self.limit)


@dataclass
class Model:
    """Sorted hash arrays, one entry per order, and what calibration has found.

    `levels[k]`: hashes of the n-grams of order k + 1, their probabilities and the weights
    they leave as contexts, both of shape (n-grams, languages). `floor`: the probability of a
    letter never seen. `usual`: what calibration has found.
    """

    languages: list[str]
    order: int
    floor: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    usual: Usual = field(default_factory=lambda: Usual({}))
    _cache: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}, "_scores": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        before = self.order - 1
        parts = [f"{BEGIN * before}{word}{END}" for word in words]
        codes = text_codes("".join(parts))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        chance = np.tile(self.floor, (len(codes), 1))
        left = np.ones((len(codes), len(self.languages)))
        for level, (hashes, probability, weight) in enumerate(self.levels):
            found = gram_hashes(codes, level + 1)
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            known = (hashes[at] == found)[:, None]
            own = np.where(known, probability[at], 0.0)
            chance = own + left * chance
            left = np.ones_like(left)
            left[1:] = np.where(known, weight[at], 1.0)[:-1]
        event = codes != ord(BEGIN)
        logs = np.where(event[:, None], np.log(np.maximum(chance, 1e-30)), 0.0)
        ends = np.cumsum(lengths)
        return np.add.reduceat(logs, ends - lengths, axis=0)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Entropy per letter of each text in each language, and letters counted."""
        runs = [letter_runs(t) if t and self.languages else [] for t in texts]
        if self._scores is None:
            self._scores = np.empty((CACHE_WORDS, len(self.languages)))
        missing = [w for w in dict.fromkeys(w for words in runs for w in words) if w not in self._cache]
        if len(self._cache) + len(missing) > CACHE_WORDS:
            self._cache.clear()
            missing = list(dict.fromkeys(w for words in runs for w in words))
            if len(missing) > len(self._scores):
                self._scores = np.empty((len(missing), len(self.languages)))
        for begin in range(0, len(missing), 20_000):
            part = missing[begin : begin + 20_000]
            first = len(self._cache)
            self._scores[first : first + len(part)] = self.word_scores(part)
            self._cache.update(zip(part, range(first, first + len(part))))
        total = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts), np.int64)
        for i, words in enumerate(runs):
            if words:
                at = np.fromiter(map(self._cache.__getitem__, words), np.int64, len(words))
                total[i] = self._scores[at].sum(axis=0)
                letters[i] = sum(map(len, words)) + len(words)
        return -total / np.maximum(letters, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        entropy, letters = self.entropies(texts)
        with_letter = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        good = with_letter & (letters > 0) & bool(self.languages)
        if not self.languages:
            entropy = np.zeros((len(texts), 1))
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        sure = np.exp(-(entropy - least[:, None]) * np.minimum(letters, 50)[:, None])
        return pd.DataFrame(
            {
                "lang_pred": np.where(good, np.array([*self.languages, UNKNOWN], object)[np.where(good, best, len(self.languages))], UNKNOWN),
                "score": np.where(good, 1.0 / sure.sum(axis=1), 0.0),
                "entropy": np.where(good, least, np.nan),
                "letters": letters,
            }
        )


def gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """lang, gram, n over all rows of `labelled` (text, lang): each task adds up what it
    reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("language counts")
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, gram, n) for lang, grams in held.items() for gram, n in grams.items()]
            held.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

        for whole in batches:
            for batch in slices([whole], "text", 4 << 20):
                words: dict[str, Counter] = {}
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    words.setdefault(lang, Counter()).update(letter_runs(text))
                for lang, counts in words.items():
                    grams = held.setdefault(lang, Counter())
                    for word, n in counts.items():
                        padded = f"{BEGIN * (order - 1)}{word}{END}"
                        for i in range(len(word) + 1):
                            grams[padded[i : i + order]] += n
                if sum(map(len, held.values())) > HELD_GRAMS:
                    yield out()
        if any(held.values()):
            yield out()

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    return _share(int((counts == 1).sum()), int((counts == 2).sum()))


def _share(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def build_model(counts: pd.DataFrame, order: int) -> Model:
    """A model of the n-gram counts (lang, gram, n) of the highest order, nothing pruned."""
    tables, grams, floor = [], counts[["lang", "gram", "n"]], {}
    languages = sorted(counts["lang"].unique())
    for _ in range(order):
        discount = grams.groupby("lang")["n"].agg(lambda n: _discount(n.to_numpy()))
        total = grams.groupby(["lang", grams["gram"].str[:-1]])["n"].transform("sum")
        chance = (grams["n"] - grams["lang"].map(discount)) / total
        tables.insert(0, grams[["lang", "gram"]].assign(p=chance.astype(float)))
        floor = grams.groupby("lang").size()
        grams = grams.assign(gram=grams["gram"].str[1:]).groupby(["lang", "gram"]).size().rename("n").reset_index()
    return assemble(tables, floor, languages)


def assemble(tables: list[pd.DataFrame], kinds: dict[str, int], languages: list[str]) -> Model:
    """A model of the probabilities (lang, gram, p) of each order, the lowest first. What those
    behind a context lack to 1 is the weight that it leaves to the lower order, be it
    discounted or pruned. `kinds`: letters of each language."""
    order = len(tables)
    if not languages:
        return Model([], order, np.zeros(0), [])
    at = {language: i for i, language in enumerate(languages)}
    rests = [t.assign(gram=t["gram"].str[:-1]).groupby(["lang", "gram"])["p"].sum().rsub(1.0).clip(lower=0.0) for t in tables]
    rests = [r.rename("p").reset_index() for r in rests]
    floor = np.ones(len(languages))
    for lang, rest in zip(rests[0]["lang"], rests[0]["p"]):
        floor[at[lang]] = rest
    floor /= np.array([kinds[language] + 1 for language in languages])
    levels = []
    for level, table in enumerate(tables):
        left = rests[level + 1] if level + 1 < order else table.iloc[:0]
        names = pd.Index(np.unique(np.concatenate((table["gram"].to_numpy(object), left["gram"].to_numpy(object)))))
        probability, weight = np.zeros((len(names), len(languages))), np.ones((len(names), len(languages)))
        for values, rows in ((probability, table), (weight, left)):
            values[names.get_indexer(rows["gram"]), rows["lang"].map(at).to_numpy(int)] = rows["p"]
        hashes = gram_hashes(text_codes("".join(names)), level + 1)[level :: level + 1]
        by_hash = np.argsort(hashes)
        levels.append((hashes[by_hash], probability[by_hash], weight[by_hash]))
    return Model(languages, order, floor, levels)


def pruned(grams: DataFrame, spread: pd.DataFrame, limits: dict[str, int]) -> DataFrame:
    """`grams` without the rarest of languages that have more than their limit; of the count at
    the limit as many stay, by hash, as it allows. `spread`: lang, n, k (n-grams counted n times)."""
    rules = []
    for lang, own in spread.groupby("lang"):
        own = own.sort_values("n", ascending=False)
        reached = own["k"].cumsum().to_numpy()
        if reached[-1] <= limits[lang]:
            continue
        i = int(np.searchsorted(reached, limits[lang]))
        cut, ties = int(own["n"].iloc[i]), int(own["k"].iloc[i])
        part = int((1 << 20) * (limits[lang] - (reached[i] - ties)) / ties)
        low = F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < part
        rules.append((lang, (F.col("n") > cut) | ((F.col("n") == cut) & low)))
    if not rules:
        return grams
    stays = F.when(F.lit(False), F.lit(False))
    for lang, rule in rules:
        stays = stays.when(F.col("lang") == lang, rule)
    return grams.where(stays.otherwise(True))


def spark_model(counts: DataFrame, order: int, least_grams: int, growth: float) -> Model:
    """The model of build_model, with sums, discounts and continuation counts over all n-grams
    worked out in Spark; only then each order of each language is pruned."""
    tables: list[pd.DataFrame] = []
    grams, limits, kinds = counts, {}, {}
    for level in range(order, 0, -1):
        spread = grams.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("k")).toArrow().to_pandas()
        if level == order:
            if not len(spread):
                return Model([], order, np.zeros(0), [])
            seen = (spread["n"] * spread["k"]).groupby(spread["lang"]).sum()
            limits = {lang: max(least_grams, int(growth * float(n) ** 0.5)) for lang, n in seen.items()}
        kinds = spread.groupby("lang")["k"].sum().to_dict()
        share = {lang: _share(*(int(own.loc[own["n"] == i, "k"].sum()) for i in (1, 2))) for lang, own in spread.groupby("lang")}
        context = F.expr(f"substring(gram, 1, {level - 1})")
        sums = grams.groupBy(F.col("lang").alias("_lang"), context.alias("_context")).agg(F.sum("n").alias("total"))
        kept = pruned(grams, spread, limits).withColumn("context", context)
        kept = kept.join(sums, (F.col("lang") == F.col("_lang")) & (F.col("context") == F.col("_context")))
        table = kept.select("lang", "gram", "n", "total").toArrow().to_pandas()
        chance = (table["n"] - table["lang"].map(share)) / table["total"]
        tables.insert(0, table[["lang", "gram"]].assign(p=chance.astype(float)))
        if level > 1:
            lower = grams.select("lang", F.expr(f"substring(gram, 2, {level - 1})").alias("gram"))
            grams = pin(lower.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"language-grams-{level - 1}")
    return assemble(tables, kinds, sorted(limits))


def calibrate(found: DataFrame, share: float = 0.999, margin: float = 3.0) -> Usual:
    """What is usual among all rows of `found` (lang, lang_pred, entropy, letters) that are rightly recognised.

    `limit` is `margin` times the excess within which `share` of them lie, at least 3; it is counted
    in steps of 1 / STEPS. Only numbers come to the driver: some for each language, and the counts of steps.
    """
    right = found.where("lang_pred = lang and letters > 0").select("lang", "entropy", F.col("letters").cast("long").alias("letters"))
    middle = right.groupBy("lang").agg(F.median("letters").alias("median"))
    sided = right.join(F.broadcast(middle), "lang").withColumn("long", F.col("letters") >= F.col("median"))
    means = sided.where("long").groupBy("lang").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("between"))
    scaled = (F.col("entropy") - F.col("mean")) * F.sqrt("letters")
    short = F.stddev_pop(F.when(~F.col("long"), scaled)).alias("by_letter")
    rows = sided.join(F.broadcast(means), "lang").groupBy("lang", "mean", "between").agg(short).collect()
    usual = Usual({r.lang: (r.mean, max(r.between, 0.02), max(r.by_letter or 0.0, 1.0)) for r in rows})
    # All excesses that leave the limit at its least count as one.
    step = F.ceil(F.greatest(usual.excess(F.col("lang"), F.col("entropy"), F.col("letters")), F.lit(3.0 / margin)) * STEPS)
    steps = right.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    if steps:
        reached = np.cumsum([r.n for r in steps])
        usual.limit = max(3.0, steps[int(np.searchsorted(reached, share * reached[-1]))].step / STEPS * margin)
    return usual


def train(labelled: DataFrame, order: int = 4, least_grams: int = 100_000, growth: float = 8.0, share: float = 0.999, margin: float = 3.0) -> Model:
    """A model of all rows of `labelled` (text, lang) with a text and a lang.

    All that are rightly recognised calibrate the rejection, too. `least_grams` and `growth`
    set how many n-grams of an order a language keeps. Without labelled rows the model knows no language.
    """
    model = spark_model(pin(gram_counts(labelled, order), "language-grams"), order, least_grams, growth)
    if model.languages:
        rows = labelled.where("text is not null and lang is not null")
        scored = rows.select(F.col("lang").cast("string").alias("lang"), identify(F.col("text"), model).alias("found"))
        model.usual = calibrate(pin(scored.select("lang", "found.*"), "language-entropies"), share, margin)
    return model


def recognise(
    docs: DataFrame, learn: Column, name: str, keep: Sequence[str] | None = None, order: int = 4, least_grams: int = 100_000, growth: float = 8.0, share: float = 0.999, margin: float = 3.0
) -> DataFrame:
    """The columns `keep` of `docs` (text, lang, ...), by default all, and the struct `name` that identify
    gives with what train finds in the rows for which `learn` is true; each text is scored once, for
    calibration and for the result."""
    counts = pin(gram_counts(docs.where(learn), order), "language-grams")
    model = spark_model(counts, order, least_grams, growth)
    keep, label = list(docs.columns if keep is None else keep), free_name(docs, "_label")
    own = F.when(learn & F.col("text").isNotNull(), F.col("lang").cast("string")).alias(label)
    scored = pin(docs.select(*keep, own, identify(F.col("text"), model).alias(name)), "language-scored")
    usual = calibrate(scored.where(F.col(label).isNotNull()).select(F.col(label).alias("lang"), f"{name}.*"), share, margin)
    return scored.select(*keep, F.col(name).withField("accepted", usual.accepts(F.col(name))).alias(name))


def identify(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score, entropy, letters and accepted for a column of texts.

    A null text or one without a letter is `und` with score 0 and not accepted. `score` is
    the share of the best language among all, as their entropies tell over 50 letters at
    most; `accepted` says whether the entropy is usual for that language.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        entering("language")
        for texts in batches:
            values = list(texts)
            parts, begin, held = [], 0, 0
            for i, value in enumerate(values):
                held += len(value or "")
                if held > 4 << 20:
                    parts.append(model.predict(values[begin : i + 1]))
                    begin, held = i + 1, 0
            if begin < len(values) or not parts:
                parts.append(model.predict(values[begin:]))
            yield pd.concat(parts, ignore_index=True)

    found = run(text)
    return found.withField("accepted", model.usual.accepts(found))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id's text leaves 0; rows without id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))
