"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line of a text. Its features are words and pairs of words that occur in
licence wording and are rare in the corpus. A multinomial logistic regression, fitted on
licence notices in whole and in parts and on all paragraphs of the corpus, gives the family.
The scan is relational: words that are features let a paragraph through, its features meet
their weights in a join, and sums per paragraph are the scores. A paragraph is reported if
its family is likelier than a threshold calibrated on paragraphs that are no licence, and
if enough of its word pairs are found in one notice of that family.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import pin
from lakewright.llm.licence_texts import FAMILIES, OTHERS

UNKNOWN = "unknown"
#: What all corpus paragraphs weigh together at most, and how common a feature may be among them.
BACKGROUND = 600
COMMON = 0.01


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Pairs of words that follow one another; none for fewer than two words."""
    at = F.sequence(F.lit(1), F.size(words) - 1)
    both = F.transform(at, lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """row, doc_id, paragraph (from 0), line: every line of every text, null texts have none."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return rows.where("text is not null").select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of constants, made inside the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def variants(text: str) -> list[str]:
    """A notice as a whole, its halves and sentences, and without every seventh word."""
    words = text.split()
    half = len(words) // 2
    parts = [text, " ".join(w for i, w in enumerate(words) if i % 7 != 3)]
    if len(words) >= 12:
        parts += [" ".join(words[:half]), " ".join(words[half:])]
        parts += [s for s in text.split(". ") if len(s.split()) >= 6]
    return parts


def background_lines(lines: DataFrame, most: int) -> DataFrame:
    """The `most` distinct lines with the smallest hashes, so copies of a line count once.

    Only hashes are shuffled; the lines below the last of them are few.
    """
    hashed = lines.select(F.xxhash64("line").alias("hash"), "line")
    least = hashed.select("hash").distinct().orderBy("hash").limit(most).collect()
    last = least[-1].hash if least else None
    return hashed.where(F.col("hash") <= F.lit(last).cast("long")).distinct().orderBy("hash", "line").limit(most)


@dataclass(frozen=True)
class Classifier:
    """Weights by feature and family, biases, the threshold, and the notices' word pairs."""

    families: list[str]
    weights: list[dict]
    bias: list[float]
    threshold: float
    pairs: list[dict]


def background_sets(docs: DataFrame, grams: set[str]) -> DataFrame:
    """grams, n: the sets of `grams` that lines of `docs` hold, and how many distinct lines hold just those.

    Every line with a word counts once, however often it is repeated. A line that shares three pairs
    of words with a notice may be one; it is no background. Hashes and grams are shuffled, no lines.
    """
    words, pairs = (sorted(g for g in grams if (" " in g) == pair) for pair in (False, True))
    lines = paragraphs(docs).select(F.xxhash64("line").alias("hash"), words_of(F.col("line")).alias("words"))
    met = F.filter(pairs_of(F.col("words")), lambda g: g.isin(pairs)).alias("pairs")
    held = lines.select("hash", F.size("words").alias("size"), F.array_distinct(F.filter("words", lambda w: w.isin(words))).alias("single"), met)
    taken = F.when((F.col("size") > 0) & (F.size("pairs") < 3), F.array_sort(F.concat("single", "pairs")))
    each = held.select("hash", taken.alias("grams")).distinct()
    # Lines left out are one group until it is written: a filter before would work the words out again.
    return pin(each.groupBy("grams").agg(F.count(F.lit(1)).alias("n")), "licence-lines").where("grams is not null")


def train(docs: DataFrame, background: int = BACKGROUND, common: float = COMMON) -> Classifier:
    """Fits the classifier on the notices and on every distinct paragraph of `docs`.

    All paragraphs count for what is rare, for the fit and for the threshold. They weigh the same, 1 each
    and `background` together at most, so that the notices keep their share in a corpus of any size.
    Null and empty texts give none, repeated rows count once, and an empty table leaves the
    notices alone."""
    spark = docs.sparkSession
    labelled = [{"line": v, "family": family} for family, texts in FAMILIES.items() for t in texts for v in variants(t)]
    labelled += [{"line": t, "family": UNKNOWN} for t in OTHERS]
    known = literal_rows(spark, labelled, "line string, family string").withColumn("words", words_of(F.col("line")))
    known = known.withColumn("grams", F.concat(F.array_distinct("words"), pairs_of(F.col("words"))))
    found = known.where(F.col("family") != UNKNOWN).select(F.explode("grams").alias("gram")).distinct().collect()
    licence_grams = {r.gram for r in found}

    other = background_sets(docs, licence_grams)
    total = other.agg(F.sum("n")).first()[0] or 0
    seen = other.select(F.explode("grams").alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    often = {r.gram for r in seen.where(F.col("n") > common * max(1, total)).collect()}
    rare = licence_grams - often
    vocabulary = sorted(g for g in rare if " " not in g or any(w in rare for w in g.split(" ")))

    rows = [{"grams": list(r.grams), "family": r.family} for r in known.select("grams", "family").collect()]
    families = [*FAMILIES, UNKNOWN]
    number = {f: i for i, f in enumerate(families)}
    table = literal_rows(spark, [{"grams": r["grams"], "label": float(number[r["family"]])} for r in rows], "grams array<string>, label double")
    kept = F.filter("grams", lambda g: g.isin(vocabulary)).alias("grams")
    other = other.select(kept, "n").groupBy("grams").agg(F.sum("n").alias("n"))
    each = F.lit(min(1.0, background / max(1, total)))
    other = pin(other.select("grams", F.lit(float(number[UNKNOWN])).alias("label"), (F.col("n") * each).alias("weight")), "licence-background")
    table = table.coalesce(1).withColumn("weight", F.lit(1.0)).unionByName(other)
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").transform(table).cache()
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.002, elasticNetParam=0.2, maxIter=60).fit(counted)
    matrix = fitted.coefficientMatrix.toArray()
    weights = [
        {"gram": g, "w": [round(float(x), 6) for x in matrix[:, i]]}
        for i, g in enumerate(vocabulary)
        if abs(matrix[:, i]).max() > 1e-4
    ]
    # The threshold: above every paragraph that is no licence, and at least one half.
    chance = fitted.transform(counted.where(F.col("label") == number[UNKNOWN])).select(vector_to_array("probability").alias("p"))
    worst = chance.agg(F.max(F.array_max(F.slice("p", 1, len(families) - 1)))).first()[0] or 0.0
    counted.unpersist()
    notices = literal_rows(spark, [{"family": f, "notice": i, "line": t} for f, texts in FAMILIES.items() for i, t in enumerate(texts)], "family string, notice int, line string")
    pairs = notices.select("family", "notice", F.explode(pairs_of(words_of(F.col("line")))).alias("pair")).collect()
    return Classifier(families, weights, [float(x) for x in fitted.interceptVector], max(0.5, min(0.95, worst * 1.05)), [r.asDict() for r in pairs])


def scan(docs: DataFrame, classifier: Classifier, overlap: float = 0.5) -> DataFrame:
    """doc_id, paragraph (from 0), family, probability, overlap: one row per paragraph that
    is recognised as licence wording.

    `overlap` is the share of the paragraph's word pairs that one notice of the family has, or
    of the notice's pairs that the paragraph has, whichever is larger. Null and empty texts
    give no row. Repeated rows are scanned each; rows without doc_id are reported with
    null. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs).withColumn("words", words_of(F.col("line")))
    gate = F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted({x["gram"] for x in classifier.weights if " " not in x["gram"]})]))
    near = lines.where(gate).withColumn("pairs", pairs_of(F.col("words")))
    number = range(len(classifier.families))
    columns = ", ".join(f"w{i} double" for i in number)
    # The model's table has one row per feature; notices bound their number.
    weights = literal_rows(spark, [{"feature": x["gram"], **{f"w{i}": v for i, v in enumerate(x["w"])}} for x in classifier.weights], f"feature string, {columns}")
    grams = near.select("row", "doc_id", "paragraph", "pairs", F.explode(F.concat(F.array_distinct("words"), F.col("pairs"))).alias("gram"))
    met = grams.join(F.broadcast(weights), F.col("gram") == F.col("feature"))
    sums = met.groupBy("row", "paragraph").agg(F.first("doc_id").alias("doc_id"), F.first("pairs").alias("pairs"), *[F.sum(f"w{i}").alias(f"w{i}") for i in number])
    scores = [F.col(f"w{i}") + F.lit(classifier.bias[i]) for i in number]
    top = F.greatest(*scores)
    total = sum((F.exp(s - top) for s in scores), F.lit(0.0))
    named = F.element_at(F.array(*[F.lit(f) for f in classifier.families]), F.array_position(F.array(*scores), top).cast("int"))
    guessed = sums.select("row", "doc_id", "paragraph", "pairs", named.alias("family"), (1.0 / total).alias("probability"))
    guessed = guessed.where((F.col("family") != UNKNOWN) & (F.col("probability") > classifier.threshold))
    notices = literal_rows(spark, classifier.pairs, "family string, notice int, pair string")
    sizes = notices.groupBy("family", "notice").agg(F.collect_list("pair").alias("own")).withColumnRenamed("family", "_family")
    compared = guessed.join(F.broadcast(sizes), F.col("family") == F.col("_family"))
    shared = F.size(F.array_intersect("pairs", "own"))
    share = F.greatest(shared / F.greatest(F.size("pairs"), F.lit(1)), shared / F.greatest(F.size("own"), F.lit(1)))
    compared = compared.select("row", "doc_id", "paragraph", "family", "probability", share.alias("overlap"))
    best = compared.groupBy("row", "doc_id", "paragraph", "family", "probability").agg(F.max("overlap").alias("overlap"))
    return best.where(F.col("overlap") >= overlap).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", "overlap")
