"""Merge, change capture and delete on small fixtures, and on a target with one very frequent key."""

import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakewright.operators.merge import (
    change_summary,
    collapse_changes,
    delete_where,
    latest_change,
    live_rows,
    merge_cdc,
    merge_upsert,
)

ENTITY = "entity_id bigint, name string, status string"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture
def entities(spark):
    return spark.createDataFrame([(1, "oak", "open"), (2, "elm", "open")], ENTITY)


def test_upsert_updates_inserts_and_keeps(spark, entities):
    source = spark.createDataFrame([(2, "elm", "shut"), (7, "fir", "open")], ENTITY)
    expected = [(1, "oak", "open"), (2, "elm", "shut"), (7, "fir", "open")]
    once = merge_upsert(entities, source, ["entity_id"])
    assert rows(once) == expected
    assert rows(merge_upsert(once, source, ["entity_id"])) == expected
    assert rows(merge_upsert(entities, source, ["entity_id"], unique_source=True)) == expected


def test_upsert_sets_only_listed_columns_and_ignores_extra_ones(spark, entities):
    source = spark.createDataFrame([("ignored", 1, "renamed", "shut")], f"extra string, {ENTITY}")
    assert rows(merge_upsert(entities, source, ["entity_id"], ["status"])) == [(1, "oak", "shut"), (2, "elm", "open")]


def test_columns_may_be_named_like_internal_ones(spark):
    target = spark.createDataFrame([(1, "x", 5)], "id int, _held string, _new int")
    source = spark.createDataFrame([(1, "y", 6), (2, "z", 7)], "id int, _held string, _new int")
    assert rows(merge_upsert(target, source, ["id"])) == [(1, "y", 6), (2, "z", 7)]


def test_chained_merges_grow_linearly(spark, tmp_path):
    for name in ("target", "source"):
        spark.range(50).selectExpr("id", f"'{name}' AS v").write.parquet(str(tmp_path / name))
    state = spark.read.parquet(str(tmp_path / "target"))
    source, leaves = spark.read.parquet(str(tmp_path / "source")), []
    for _ in range(3):
        state = merge_upsert(state, source, ["id"])
        leaves.append(state._jdf.queryExecution().optimizedPlan().collectLeaves().size())
    assert leaves[1] - leaves[0] == leaves[2] - leaves[1] <= 3


def test_upsert_can_set_null(spark, entities):
    source = spark.createDataFrame([(1, None, None)], ENTITY)
    assert (1, None, None) in rows(merge_upsert(entities, source, ["entity_id"]))


def test_upsert_casts_to_the_target_types(spark):
    gold = spark.createDataFrame([(1, 1.5)], "day int, revenue double")
    daily = spark.sql("SELECT 1L AS day, CAST(2.25 AS DECIMAL(12,2)) AS revenue UNION ALL SELECT 2L, 3.00")
    merged = merge_upsert(gold, daily, ["day"])
    assert merged.schema == gold.schema
    assert rows(merged) == [(1, 2.25), (2, 3.0)]


def test_null_keys_never_match(spark):
    target = spark.createDataFrame([(None, "old", "x")], ENTITY)
    source = spark.createDataFrame([(None, "new", "x")], ENTITY)
    assert rows(merge_upsert(target, source, ["entity_id"])) == [(None, "new", "x"), (None, "old", "x")]


@pytest.mark.parametrize("broadcast_rows, even_rows", [(1_000_000, 1_000_000), (-1, 1_000_000), (-1, 0)])
def test_two_source_rows_for_one_target_row_raise(spark, entities, monkeypatch, broadcast_rows, even_rows):
    monkeypatch.setattr("lakewright.operators.merge.BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr("lakewright.operators.merge.EVEN_ROWS", even_rows)
    source = spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], ENTITY)
    with pytest.raises(PySparkException, match="several source rows"):
        merge_upsert(entities, source, ["entity_id"]).count()
    with pytest.raises(PySparkException, match="several source rows"):
        merge_cdc(entities, source.withColumn("op", F.lit("U")), ["entity_id"]).collect()


def test_repeated_source_rows_without_match_are_all_inserted(spark, entities):
    source = spark.createDataFrame([(9, "a", "x"), (9, "b", "x")], ENTITY)
    assert rows(merge_upsert(entities, source, ["entity_id"]))[2:] == [(9, "a", "x"), (9, "b", "x")]


def test_composite_key(spark):
    target = spark.createDataFrame([(1, "a", 10), (1, "b", 20)], "k1 int, k2 string, v int")
    source = spark.createDataFrame([(1, "b", 21), (2, "a", 30)], "k1 int, k2 string, v int")
    assert rows(merge_upsert(target, source, ["k1", "k2"])) == [(1, "a", 10), (1, "b", 21), (2, "a", 30)]


def test_cdc_applies_update_delete_insert(spark):
    target = spark.createDataFrame(
        [(5, "rook", "white"), (6, "pawn", "black"), (8, "king", "white")], ENTITY
    )
    outbox = spark.createDataFrame(
        [
            (8, "queen", "black", "U"),
            (5, "rook", "white", "D"),
            (9, "knight", "white", "I"),
        ],
        f"{ENTITY}, op string",
    )
    assert rows(merge_cdc(target, outbox, ["entity_id"])) == [
        (6, "pawn", "black"),
        (8, "queen", "black"),
        (9, "knight", "white"),
    ]


@pytest.mark.parametrize(
    "change, expected",
    [
        ((1, "new", "x", "I"), [(1, "oak", "open"), (2, "elm", "open")]),
        ((9, "new", "x", "U"), [(1, "oak", "open"), (2, "elm", "open")]),
        ((9, "new", "x", "D"), [(1, "oak", "open"), (2, "elm", "open")]),
        ((1, "new", "x", None), [(1, "oak", "open"), (2, "elm", "open")]),
        ((9, "new", "x", None), [(1, "oak", "open"), (2, "elm", "open")]),
        ((None, "new", "x", "D"), [(1, "oak", "open"), (2, "elm", "open")]),
        ((None, "new", "x", "I"), [(1, "oak", "open"), (2, "elm", "open"), (None, "new", "x")]),
    ],
)
def test_cdc_pairs_without_effect(spark, entities, change, expected):
    outbox = spark.createDataFrame([change], f"{ENTITY}, op string")
    assert rows(merge_cdc(entities, outbox, ["entity_id"])) == expected


def replay(exists, ops):
    """State of one key after well-formed changes: the value, or None when absent."""
    value = "start" if exists else None
    for op, new in ops:
        value = None if op == "D" else new
    return value


@pytest.mark.parametrize(
    "exists, ops",
    [
        (False, "I"), (False, "IU"), (False, "IUD"), (False, "IDI"), (False, "IUDIU"), (False, "ID"),
        (True, "U"), (True, "D"), (True, "UUD"), (True, "DI"), (True, "DIU"), (True, "UDIUD"), (True, "DIDI"),
    ],
)
def test_collapsed_changes_have_the_effect_of_replaying_them(spark, exists, ops):
    schema = "k bigint, v string, op string, at bigint"
    changes = [(1, f"v{i}", op, i) for i, op in enumerate(ops)]
    outbox = spark.createDataFrame(list(reversed(changes)), schema)
    target = spark.createDataFrame([(1, "start")] if exists else [], "k bigint, v string")
    net = collapse_changes(outbox, ["k"], "op", ["at"])
    assert net.count() == 1
    got = rows(merge_cdc(target, net, ["k"], unique_source=True))
    want = replay(exists, [(op, v) for _, v, op, _ in changes])
    assert got == ([] if want is None else [(1, want)])


def test_collapse_ignores_unknown_ops_and_takes_ties_by_later_columns(spark):
    outbox = spark.createDataFrame(
        [(1, "a", "I", 5, 1), (1, "b", "U", 5, 2), (1, "c", None, 9, 3), (1, "d", "Z", 9, 4)],
        "k int, v string, op string, at int, id int",
    )
    assert rows(collapse_changes(outbox, ["k"], "op", ["at", "id"])) == [(1, "b", "I", 5, 2)]


def test_latest_change(spark):
    log = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None)], "k int, at int, v string")
    assert rows(latest_change(log, ["k"], ["at"])) == [(1, 7, "b"), (2, 1, None)]


def test_delete_keeps_rows_with_unknown_predicate(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert rows(delete_where(df, F.col("id") == 1)) == [(2,), (None,)]


def test_live_rows(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_deleted boolean")
    assert [r.id for r in live_rows(df).orderBy("id").collect()] == [2, 3]


def test_change_summary_counts_rows_of_repeated_keys_too(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "d")], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (5, "e"), (None, None)], "k int, v string")
    got = {r.change: r.row_count for r in change_summary(before, after, ["k"]).collect()}
    assert got == {"inserted": 2, "updated": 1, "deleted": 2, "unchanged": 2}


def test_change_summary_of_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v string")
    got = {r.change: r.row_count for r in change_summary(empty, empty, ["k"]).collect()}
    assert got == {"inserted": 0, "updated": 0, "deleted": 0, "unchanged": 0}


@pytest.mark.parametrize("strategy", ["sampled", "repeated source", "even"])
def test_large_sides(spark, settings, capsys, monkeypatch, strategy):
    """A third of the target shares one key and nothing may be broadcast."""
    settings(
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        }
    )
    module = "lakewright.operators.merge"
    monkeypatch.setattr(f"{module}.BROADCAST_ROWS", -1)
    monkeypatch.setattr(f"{module}.LARGE_TARGET", 1000 if strategy == "sampled" else 10**9)
    monkeypatch.setattr(f"{module}.SAMPLE_ROWS", 2000)
    monkeypatch.setattr(f"{module}.EVEN_ROWS", 10**9 if strategy == "even" else 0)
    ids = spark.range(0, 30000, 1, 8)
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    target = ids.select(key.alias("k"), F.col("id").alias("v"))
    source = spark.range(0, 60000, 2, 8).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v"))
    source = source.unionByName(spark.sql("SELECT 7L AS k, -2L AS v UNION ALL SELECT NULL, -3L"))
    merged = merge_upsert(target, source, ["k"])
    values = [r.v for r in merged.collect()]
    # Key 7 stands on every third row and on row 7; every even key of the source ends up once.
    assert values.count(-2) == 10001
    assert values.count(-1) == 30000
    assert values.count(-3) == 1
    kept = [i for i in range(30000) if i % 3 and i % 2 and i != 7]
    assert sorted(v for v in values if v >= 0) == kept
    merged.explain()
    plan = capsys.readouterr().out
    assert ("FullOuter" in plan) == (strategy == "even")
    assert ("SortMergeJoin(skew=true)" in plan) == (strategy != "even")
    # A sampled frequent key reaches the anti join once.
    assert ("LeftSemi" in plan) == (strategy == "sampled")


def test_a_small_source_is_broadcast_and_the_target_is_not_shuffled(spark, capsys):
    target = spark.range(0, 200000, 1, 8).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    source = spark.createDataFrame([(5, 1), (-1, 1)], "k bigint, v int")
    merged = merge_upsert(target, source, ["k"])
    assert merged.filter("v = 1").count() == 2
    merged.collect()
    merged.explain()
    assert "BroadcastHashJoin [k" in capsys.readouterr().out


KEYS = st.one_of(st.none(), st.integers(0, 6))
STATE = st.dictionaries(st.integers(0, 6), st.sampled_from("abc"), max_size=6)
CHANGES = st.lists(st.tuples(KEYS, st.sampled_from("xyz"), st.sampled_from(["I", "U", "D", None])), max_size=6, unique_by=lambda c: c[0])


@pytest.mark.parametrize("broadcast_rows, even_rows", [(1_000_000, 1_000_000), (-1, 1_000_000), (-1, 0)])
@hypothesis_settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(state=STATE, changes=CHANGES)
def test_random_changes(spark, monkeypatch, broadcast_rows, even_rows, state, changes):
    monkeypatch.setattr("lakewright.operators.merge.BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr("lakewright.operators.merge.EVEN_ROWS", even_rows)
    target = spark.createDataFrame(sorted(state.items()), "k int, v string")
    outbox = spark.createDataFrame(changes, "k int, v string, op string")
    after, upserted = dict(state), list(state.items())
    extra = []
    for k, v, op in changes:
        if op == "D":
            after.pop(k, None)
        elif op == "U" and k in state:
            after[k] = v
        elif op == "I" and k is None:
            extra.append((k, v))
        elif op == "I" and k not in state:
            after[k] = v
    assert rows(merge_cdc(target, outbox, ["k"])) == sorted([*after.items(), *extra], key=repr)
    expected = {**state, **{k: v for k, v, _ in changes if k is not None}}
    nulls = [(None, v) for k, v, _ in changes if k is None]
    got = merge_upsert(target, outbox.drop("op"), ["k"])
    assert rows(got) == sorted([*expected.items(), *nulls], key=repr)
    counts = {r.change: r.row_count for r in change_summary(target, got, ["k"]).collect()}
    assert counts["unchanged"] + counts["updated"] == len(state)
    assert counts["inserted"] == len(expected) - len(state) + len(nulls)
    assert counts["updated"] == sum(expected[k] != v for k, v in upserted)
