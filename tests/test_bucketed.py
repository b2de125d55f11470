"""Merges into bucketed tables: results, plans, layout."""

import glob
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lakewright.operators.merge import merge_upsert
from lakewright.sinks import bucketed

SCHEMA = "id bigint, part string, value double"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def fresh_name():
    return f"t_{uuid.uuid4().hex}"


@pytest.fixture
def make(spark, tmp_path):
    def build(data, keys=("id",), buckets=4, schema=SCHEMA):
        name = fresh_name()
        return bucketed.write_bucketed(spark.createDataFrame(data, schema), name, str(tmp_path / name), keys, buckets)

    return build


def merge(spark, table, source, tmp_path, set_cols=None):
    name = fresh_name()
    return bucketed.merge_bucketed(spark, table, source, name, str(tmp_path / name), set_cols)


def test_chained_merges_equal_the_plain_ones(spark, make, tmp_path):
    rng = random.Random(4)
    held = [(i, f"p{i % 3}", float(i)) for i in range(300)] + [(None, "null", 1.0), (None, "null", 1.0)]
    table, plain = make(held, keys=("id", "part")), spark.createDataFrame(held, SCHEMA)
    for step in range(3):
        keys = rng.sample(range(600), 120)
        source = spark.createDataFrame([(i, f"p{i % 3}", -1.0 - step) for i in keys] + [(None, "x", 0.0)], SCHEMA)
        table = merge(spark, table, source, tmp_path)
        plain = merge_upsert(plain, source, ["id", "part"])
        assert rows(spark.table(table.name)) == rows(plain)


def test_only_the_source_is_shuffled(spark, make, settings):
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "50"})
    table = make([(i, "a", 1.0) for i in range(500)])
    source = spark.range(400, 900).select("id", F.lit("b").alias("part"), F.lit(2.0).alias("value"))
    merged = bucketed.merged_rows(spark, table, source)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Bucketed: true" in plan
    scan = plan[: plan.index("Bucketed: true")]
    assert "Exchange" not in scan
    assert merged.count() == 900


def test_a_bucket_is_one_file_after_a_merge(spark, make, tmp_path):
    table = make([(i, "a", 1.0) for i in range(500)])
    assert len(glob.glob(f"{table.path}/*.parquet")) == 4
    after = merge(spark, table, spark.createDataFrame([(i, "b", 2.0) for i in range(490, 700)], SCHEMA), tmp_path)
    assert len(glob.glob(f"{after.path}/*.parquet")) == 4


def test_set_columns_casts_and_clashing_names(spark, make, tmp_path):
    schema = "id bigint, _held string, _new double, _rows int"
    table = make([(1, "a", 1.0, 1), (2, "b", 2.0, 2)], schema=schema)
    source = spark.createDataFrame([("2", "x", 9, 8, "extra"), ("3", "y", 7, 6, "extra")], "id string, _held string, _new int, _rows bigint, more string")
    after = merge(spark, table, source, tmp_path, ["_new"])
    assert rows(spark.table(after.name)) == [(1, "a", 1.0, 1), (2, "b", 9.0, 2), (3, "y", 7.0, 6)]


def test_repeated_source_rows(spark, make, tmp_path):
    table = make([(1, "a", 1.0)])
    twice = spark.createDataFrame([(5, "b", 2.0), (5, "b", 2.0)], SCHEMA)
    assert rows(bucketed.merged_rows(spark, table, twice)) == [(1, "a", 1.0), (5, "b", 2.0), (5, "b", 2.0)]
    with pytest.raises(Exception, match="several source rows"):
        bucketed.merged_rows(spark, table, twice.withColumn("id", F.lit(1))).collect()


def test_empty_sides_and_null_values(spark, make, tmp_path):
    empty = make([])
    source = spark.createDataFrame([(1, None, None), (None, "n", 1.0)], SCHEMA)
    table = merge(spark, empty, source, tmp_path)
    assert rows(spark.table(table.name)) == rows(source)
    table = merge(spark, table, spark.createDataFrame([], SCHEMA), tmp_path)
    assert rows(spark.table(table.name)) == rows(source)


def test_another_name_finds_the_layout(spark, make, tmp_path):
    table = make([(i, f"p{i}", 1.0) for i in range(50)], keys=("part", "id"), buckets=3)
    again = bucketed.open_bucketed(spark, fresh_name(), table.path)
    assert (again.keys, again.buckets) == (("part", "id"), 3)
    after = merge(spark, again, spark.createDataFrame([(7, "p7", 5.0), (70, "p70", 5.0)], SCHEMA), tmp_path)
    assert spark.table(after.name).filter("value = 5.0").count() == 2
    assert spark.table(after.name).count() == 51


def test_keys_without_one_hash_are_refused(make):
    with pytest.raises(ValueError):
        make([(1, "a", 1.0)], keys=("value",))
    with pytest.raises(ValueError):
        make([(1, "a", 1.0)], keys=())
