"""Log records over blocks, pages of logs, salted joins and aggregates, balanced reads."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakewright.operators import files
from lakewright.operators.salting import frequent_keys, salted_aggregate, salted_join
from lakewright.sources.logs import line_index, line_page, log_records
from lakewright.sources.ranges import cuts, plan_ranges, predicates, read_ranges, split_column


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def blocks_of(spark, size):
    return files.private_session(spark, {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1})


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_stack_traces_join_their_header_across_blocks(spark, tmp_path, block):
    rng = random.Random(3)
    folder, want = tmp_path / "logs", []
    folder.mkdir()
    for name in ("a.log", "b.log"):
        text = ["stray line"] if name == "b.log" else []
        want += [(None, None, None, "stray line", 1)] if text else []
        for n in range(60):
            trace = [f"\tat place {n}.{k}" + "x" * rng.randrange(90) for k in range(rng.choice([0, 0, 1, 2, 30]))]
            text += [f"26/01/02 03:04:{n % 60:02d} WARN Part{n}: went wrong: {n}", *trace]
            want.append((dt.datetime(2026, 1, 2, 3, 4, n % 60), "WARN", f"Part{n}", "\n".join([f"went wrong: {n}", *trace]), 1 + len(trace)))
        (folder / name).write_text("\n".join(text) + "\n")
    got = log_records(blocks_of(spark, block), str(folder))
    assert rows(got.drop("file")) == sorted(want, key=repr)
    assert got.select("file").distinct().count() == 2


def test_only_records_across_blocks_are_shuffled_again(spark, tmp_path, capsys):
    (tmp_path / "a.log").write_text("".join(f"26/01/02 03:04:05 WARN Part: n {n}\n\tat place {n}\n" for n in range(90)))
    got = log_records(blocks_of(spark, 200), str(tmp_path))
    got.explain()
    plan = capsys.readouterr().out
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan
    assert rows(got.select("message", "line_count")) == sorted([(f"n {n}\n\tat place {n}", 2) for n in range(90)], key=repr)


def test_records_of_empty_files_and_lines_without_header(spark, tmp_path):
    (tmp_path / "a").write_text("")
    assert log_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "b").write_text("one\n\ntwo\n")
    assert rows(log_records(spark, str(tmp_path)).select("message", "line_count")) == [("", 1), ("one", 1), ("two", 1)]


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_a_page_reads_only_its_files(spark, tmp_path, block):
    folder = tmp_path / "my logs"
    folder.mkdir()
    for n in range(6):
        (folder / f"part-{n}.log").write_text("".join(f"line {n * 40 + k}\n" for k in range(40)))
    (folder / "part-9.log").write_text("")
    small = blocks_of(spark, block)
    index = line_index(small, str(folder))
    assert [(r.first_line, r.lines) for r in index.orderBy("file").collect()] == [(n * 40, 40) for n in range(6)]
    for start, size in [(0, 10), (35, 10), (79, 2), (100, 100), (235, 50), (240, 5), (10, 0)]:
        want = [(n, f"line {n}") for n in range(start, min(start + size, 240))]
        assert sorted(map(tuple, line_page(small, index, start, size).collect())) == want
    kept = spark.createDataFrame(index.filter("first_line = 80").collect(), index.schema)
    for n in (0, 1, 3, 4, 5):
        (folder / f"part-{n}.log").unlink()
    assert sorted(map(tuple, line_page(small, kept, 90, 5).collect())) == [(n, f"line {n}") for n in range(90, 95)]
    assert line_page(small, kept.limit(0), 90, 5).count() == 0


def skewed(spark, n=4000):
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, None, rng.randrange(300)]), i, rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(data, "k bigint, id bigint, _salt int").repartition(6)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("task_rows", [100, 10**9])
def test_salted_join_is_the_plain_join(spark, how, task_rows):
    left = skewed(spark)
    right = spark.createDataFrame([(k, f"v{k}") for k in [1, 1, *range(0, 200, 2)]] + [(None, "n")], "k bigint, label string")
    assert rows(salted_join(left, right, ["k"], how, task_rows=task_rows)) == rows(left.join(right, ["k"], how))


def test_salted_join_spreads_a_frequent_key(spark, settings):
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"})
    left, right = skewed(spark, 20000), spark.createDataFrame([(1, "x")], "k bigint, label string")
    size = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert size(left.join(right, "k")) > 11000
    assert size(salted_join(left, right, ["k"], task_rows=300)) < 4000


def test_frequent_keys_include_null_and_bounds_hold(spark):
    found = frequent_keys(skewed(spark), ["k"])
    assert len(found.hashes) == 2 and 2000 < found.most < 2800
    assert frequent_keys(skewed(spark).limit(0), ["k"]).hashes == ()
    assert frequent_keys(spark.range(5000), ["id"]).hashes == ()
    with pytest.raises(ValueError):
        salted_join(skewed(spark), skewed(spark), ["k"], "full")


def test_salted_aggregate_is_the_plain_one(spark):
    df = skewed(spark)
    totals = {"n": ("count", F.lit(1)), "s": ("sum", F.col("id")), "lo": ("min", F.col("id")), "hi": ("max", F.col("id")), "v": ("count", F.col("k"))}
    plain = df.groupBy("k").agg(F.count(F.lit(1)), F.sum("id"), F.min("id"), F.max("id"), F.count("k"), F.count_distinct("_salt"))
    assert rows(salted_aggregate(df, ["k"], totals, ("d", "_salt"))) == rows(plain)
    assert salted_aggregate(df.limit(0), ["k"], totals).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        salted_aggregate(df, ["k"], {"m": ("median", F.col("id"))})


CASES = {
    "bigint": [None, 5, 5, 5, 5, 5, 5, *range(-40, 40)],
    "double": [None, float("nan"), float("inf"), -float("inf"), 0.1, 1e300, *[x / 7 for x in range(60)], *[2.5] * 30],
    "decimal(12,2)": [None, Decimal("-3.10"), *[Decimal(n) / 4 for n in range(50)]],
    "date": [None, *[dt.date(2020, 1, 1) + dt.timedelta(days=n) for n in range(90)]],
    "timestamp": [None, *[dt.datetime(2020, 1, 1, 0, 0, 0, n * 1000) for n in range(50)]],
    "timestamp_ntz": [None, *[dt.datetime(2020, 1, 1, n % 24, 7) + dt.timedelta(days=n) for n in range(50)]],
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("parts", [1, 2, 7])
def test_every_row_meets_one_condition(spark, kind, parts):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(CASES[kind])], f"id bigint, v {kind}")
    found = plan_ranges(df, "v", parts)
    back = read_ranges(df, found, "part")
    assert sorted(r.id for r in back.select("id").collect()) == list(range(len(CASES[kind])))
    if parts > 1:
        assert back.select("part").distinct().count() >= 2


def test_parts_are_even_and_a_frequent_value_is_alone(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("v"))
    found = plan_ranges(df, "v", 10)
    sizes = {r.part: r["count"] for r in read_ranges(df, found, "part").groupBy("part").count().collect()}
    assert max(sizes.values()) == 3335 and sorted(sizes.values())[-2] <= 1100
    assert any("77 AND" in f and ">= 77" in f and "<= 77" in f for f in found)


def test_conditions_for_nothing_and_without_a_column(spark):
    empty = spark.createDataFrame([], "v int, t string")
    assert read_ranges(empty, plan_ranges(empty, "v", 4)).count() == 0
    texts = spark.createDataFrame([("a",), (None,)], "t string")
    assert split_column(texts) is None and read_ranges(texts, plan_ranges(texts)).count() == 2
    with pytest.raises(ValueError):
        cuts(texts, "t", 3)
    assert predicates("v", empty.schema["v"].dataType, []) == ["v IS NULL OR v IS NOT NULL"]
    wide = spark.range(100).select((F.col("id") % 3).alias("few"), "id", F.lit("x").alias("t"))
    assert split_column(wide) == "id"
    assert not math.isnan(len(plan_ranges(wide)))
