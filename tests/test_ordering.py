"""Order-dependent operators against plain Python, with groups below and above the size limit."""

import random

import pytest

from lakewright.operators.ordering import (
    drop_consecutive_duplicates,
    last_n,
    page,
    page_after,
    page_state,
    sorted_chunks,
)

LIMITS = [10, 10_000_000]


def statements(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "at bigint, statement string")


@pytest.mark.parametrize("limit", LIMITS)
def test_consecutive_duplicates_without_partition(spark, limit):
    texts = ["show", "count", "count", "count", "show", "show", "drop"] * 4
    got = drop_consecutive_duplicates(statements(spark, texts), ["statement"], [], ["at"], limit)
    kept = [t for i, t in enumerate(texts) if i == 0 or t != texts[i - 1]]
    assert [r.statement for r in got.orderBy("at").collect()] == kept


@pytest.mark.parametrize("limit", [50, 400, 10_000_000])
def test_consecutive_duplicates_match_brute_force(spark, limit):
    """One user has a third of all rows, one has no name, values may be null, times repeat."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        user = rng.choice(["hot", None, "a", "b", "c", "d"] + ["hot"] * 2)
        rows.append((user, rng.randrange(40) if user == "hot" else i, rng.choice(["x", "y", None]), i // 2))
    df = spark.createDataFrame(rows, "user string, at bigint, kind string, extra bigint").repartition(8)
    got = drop_consecutive_duplicates(df, ["kind"], ["user"], ["at"], limit)

    def nulls_first(value):
        return (value is not None, value)

    expected = []
    for user in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], nulls_first(r[2]), r[3]))
        expected += [r for i, r in enumerate(mine) if i == 0 or mine[i - 1][2] != r[2]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("limit", LIMITS)
def test_consecutive_duplicates_with_unique_order(spark, limit):
    df = spark.range(0, 1000, 1, 8).selectExpr("id % 3 AS g", "id AS at", "id % 12 DIV 6 AS v").repartition(8)
    got = drop_consecutive_duplicates(df, ["v"], ["g"], ["at"], limit, unique_order=True)
    kept = [i for i in range(1000) if i < 3 or i % 12 // 6 != (i - 3) % 12 // 6]
    assert sorted(r.at for r in got.collect()) == kept


def test_sorted_chunks_split_a_frequent_leading_value(spark):
    df = spark.range(0, 50000, 1, 8).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id")
    chunks = sorted_chunks(df, ["k", "id"])
    per_chunk = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
    assert sum(per_chunk) == 50000
    in_order = [(r.k, r.id) for r in chunks.orderBy("_chunk", "_row").collect()]
    assert in_order == sorted(in_order)


def test_last_n_keeps_order(spark):
    df = statements(spark, [f"line {i}" for i in range(873)]).repartition(7)
    got = [r.statement for r in last_n(df, 37, ["at"]).collect()]
    assert got == [f"line {i}" for i in range(836, 873)]


@pytest.mark.parametrize("heap", [0, 1_000_000])
@pytest.mark.parametrize("start, size", [(0, 100), (250, 100), (2950, 100), (2999, 1), (3000, 100)])
def test_page_near_and_far(spark, heap, start, size):
    df = spark.range(0, 3000, 1, 8).selectExpr("id * 7 % 3000 AS line_no", "id % 5 AS other").repartition(8)
    got = [r.line_no for r in page(df, ["line_no"], start, size, max_heap_rows=heap).collect()]
    assert got == list(range(3000))[start : start + size]


@pytest.mark.parametrize("heap", [0, 1_000_000])
def test_page_orders_ties_by_the_other_columns(spark, heap):
    df = spark.range(0, 900, 1, 8).selectExpr("0 AS k", "id").repartition(8)
    assert [r.id for r in page(df, ["k"], 700, 5, max_heap_rows=heap).collect()] == [700, 701, 702, 703, 704]


@pytest.mark.parametrize("heap", [0, 300, 1_000_000])
@pytest.mark.parametrize("start", [0, 190, 380, 590, 890])
def test_page_with_nulls_strings_and_repeated_keys(spark, heap, start):
    df = spark.range(0, 900, 1, 8).selectExpr(
        "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE CONCAT('k', id % 7) END AS k",
        "IF(id % 11 = 0, NULL, id % 4) AS n", "id",
    ).repartition(8)
    def nulls_first(value):
        return (value is not None, value)

    everything = sorted(map(tuple, df.collect()), key=lambda r: tuple(map(nulls_first, r)))
    got = [tuple(r) for r in page(df, ["k", "n"], start, 30, max_heap_rows=heap).collect()]
    assert got == everything[start : start + 30]


def test_far_page_reads_only_rows_of_its_key_range(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.range(0, 3000, 1, 8).selectExpr("id AS line_no", "CAST(id AS STRING) AS line").write.parquet(path)
    page(spark.read.parquet(path), ["line_no"], 2000, 10, max_heap_rows=100).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(line_no" in plan and "LessThanOrEqual(line_no" in plan


def test_far_page_of_equal_rows(spark):
    df = spark.range(0, 900, 1, 8).selectExpr("IF(id < 700, 5, 9) AS k")
    assert [r.k for r in page(df, ["k"], 690, 20, max_heap_rows=0).collect()] == [5] * 10 + [9] * 10


def test_page_after_walks_all_rows(spark):
    df = spark.range(0, 25).selectExpr("id % 3 AS a", "id AS b")
    seen, key = [], [-1, -1]
    while True:
        rows = page_after(df, ["a", "b"], key, 10).collect()
        if not rows:
            break
        seen += [(r.a, r.b) for r in rows]
        key = list(seen[-1])
    assert seen == sorted((i % 3, i) for i in range(25))


@pytest.mark.parametrize("start, expected", [(0, (0, 3, 3, 3, True)), (2, (2, 1, 3, 3, True)), (9, (9, 0, 3, 9, True))])
def test_page_state_of_a_short_log(spark, start, expected):
    df = statements(spark, ["a", "b", "c"])
    assert tuple(page_state(df, start).first()) == expected


def test_page_state_with_more_to_come(spark):
    assert tuple(page_state(spark.range(250), 100).first()) == (100, 100, 250, 200, False)
