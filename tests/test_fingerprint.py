"""Fingerprints of tables, differences between tables, keys gone at the source."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakewright.operators.fingerprint import bucket_prints, changed_rows, rows_unchanged, table_print, unequal_buckets
from lakewright.plans.reconcile import differing_keys, mark_deletions, sync_files
from lakewright.sinks import versions
from lakewright.sinks.versions import FileTable

SCHEMA = "a bigint, b string, c double, d array<int>"
NOW = dt.datetime(2030, 1, 1)


def made(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def some(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, rng.randrange(5)]), rng.choice([None, "", "x"]), rng.choice([0.0, -0.0, None, 1.5]), rng.choice([None, [], [None, 1], [1, None]])) for _ in range(n)]


def passed(check):
    return check.first().passed


def test_order_and_layout_do_not_matter_but_repeats_do(spark):
    rows = some(300)
    shuffled = random.Random(2).sample(rows, len(rows))
    assert table_print(made(spark, rows)).first() == table_print(made(spark, shuffled, 7)).first()
    assert passed(rows_unchanged(made(spark, rows), made(spark, shuffled, 1)))
    assert not passed(rows_unchanged(made(spark, rows), made(spark, rows + rows[:1])))
    twice = [(1, "x", 1.0, None)] * 2 + [(2, "y", 1.0, None)]
    assert not passed(rows_unchanged(made(spark, twice), made(spark, twice[:1] + twice[2:] * 2)))


def test_nulls_at_different_places_differ(spark):
    for one, two in [((None, "x", None, None), (None, None, None, None)), ((None, "", 0.0, []), (None, None, 0.0, [])), ((1, "x", 1.0, [None, 1]), (1, "x", 1.0, [1, None]))]:
        assert not passed(rows_unchanged(made(spark, [one]), made(spark, [two])))
    ints = "x int, y int"
    left, right = spark.createDataFrame([(1, None)], ints), spark.createDataFrame([(None, 1)], ints)
    assert not passed(rows_unchanged(left, right))
    assert passed(rows_unchanged(made(spark, [(1, "x", 0.0, None)]), made(spark, [(1, "x", -0.0, None)])))


@pytest.mark.parametrize("buckets", [1, 8, 4096])
def test_changed_rows_are_those_of_a_multiset_difference(spark, buckets):
    before, after = some(400), some(400)[5:] + some(20, seed=9) + [(None,) * 4] * 3
    plain = [[(a, b, None if c is None else c + 0.0, d and tuple(d) if d else d and () or (None if d is None else ())) for a, b, c, d in side] for side in (before, after)]
    want = sorted([(*r, plain[0].count(r), plain[1].count(r)) for r in set(plain[0]) | set(plain[1]) if plain[0].count(r) != plain[1].count(r)], key=repr)
    got = changed_rows(made(spark, before), made(spark, after), buckets=buckets).collect()
    assert sorted([(r.a, r.b, None if r.c is None else r.c + 0.0, None if r.d is None else tuple(r.d), r.rows_before, r.rows_after) for r in got], key=repr) == want
    assert changed_rows(made(spark, before), made(spark, before), buckets=buckets).count() == 0


def test_one_changed_row_touches_two_buckets_at_most(spark):
    before = spark.range(50_000).withColumn("v", F.col("id") * 2)
    after = before.withColumn("v", F.when(F.col("id") == 777, -1).otherwise(F.col("v")))
    assert unequal_buckets(before, after, ["id", "v"]).count() in (1, 2)
    assert sorted(tuple(r) for r in changed_rows(before, after).collect()) == [(777, -1, 0, 1), (777, 1554, 1, 0)]


def test_empty_tables_and_unfit_types(spark):
    empty = made(spark, some(1)).limit(0)
    assert tuple(table_print(empty).first()) == (0, 0, 0)
    assert passed(rows_unchanged(empty, empty)) and not passed(rows_unchanged(empty, made(spark, some(1))))
    assert changed_rows(empty, made(spark, some(3))).agg(F.sum("rows_after")).first()[0] == 3
    assert bucket_prints(empty).count() == 0
    with pytest.raises(ValueError, match="types differ"):
        changed_rows(made(spark, some(1)), made(spark, some(1)).withColumn("a", F.col("a").cast("int")))
    with pytest.raises(ValueError, match="maps"):
        table_print(spark.range(1).withColumn("m", F.create_map(F.lit(1), F.lit(2))))


def test_columns_may_be_called_like_internal_ones(spark):
    left = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "bucket int, row_count int, print_a int")
    assert [tuple(r) for r in changed_rows(left, left.limit(1)).collect()] == [(1, 2, 4, 1, 0)]


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_keys_of_one_side_only(spark, buckets):
    source = spark.createDataFrame([(str(i), "x") for i in [*range(0, 500), 900, 900]] + [(None, "x")], "k string, other string")
    target = spark.createDataFrame([(i, "y") for i in [*range(10, 505), 12]] + [(None, "y")], "k bigint, v string")
    got = sorted(tuple(r) for r in differing_keys(source, target, ["k"], buckets).collect())
    assert got == sorted([(i, "new") for i in [*range(10), 900]] + [(i, "gone") for i in range(500, 505)])
    assert differing_keys(target, target, ["k"], buckets).count() == 0
    assert differing_keys(target.limit(0), target, ["k"], buckets).count() == 495


def test_tombstones_rewrite_only_their_files_and_go_when_a_key_comes_back(spark, tmp_path):
    schema = "id bigint, part int, mark bigint, is_deleted boolean"
    table = FileTable(str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ("part",))
    source = spark.createDataFrame([(i, i % 4, i) for i in range(40)], "id bigint, part int, mark bigint")
    sync_files(spark, table, source, ["id"], "mark", "is_deleted", NOW)
    done = sync_files(spark, table, source.where("id <> 6"), ["id"], "mark", "is_deleted", NOW)
    assert [(d.removed, d.before) for d in done] == [(1, 4), (1, 4)]
    flagged = versions.read_table(spark, table).where("is_deleted").collect()
    assert [(r.id, r.part, r.mark) for r in flagged] == [(6, 2, 6)]
    assert mark_deletions(spark, table, source.where("id <> 6"), ["id"], "is_deleted", NOW).removed == 0
    back = source.where("id <> 6").unionByName(spark.createDataFrame([(6, 2, 99)], source.schema))
    sync_files(spark, table, back, ["id"], "mark", "is_deleted", NOW)
    rows = versions.read_table(spark, table)
    assert rows.where("is_deleted").count() == 0 and rows.count() == 40 and rows.where("mark = 99").count() == 1


def test_differing_keys_joins_nothing(spark, capsys):
    found = differing_keys(spark.range(5, 40), spark.range(0, 30), ["id"])
    found.explain()
    assert "Join" not in capsys.readouterr().out
    assert found.count() == 15
