"""Column helpers, export, checks, generated rows and plain aggregates."""

import datetime as dt
import glob

import pytest
from hypothesis import HealthCheck, given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewright.functions import formats
from lakewright.operators import aggregates, checks
from lakewright.sinks.export import export, read_csv, render_tsv
from lakewright.sources.generated import generate_users


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1536, 104704, 1048575, 1048576, 44040192, 43302912, 1073741823, 1073741824, 5368709120, None]
    assert apply(spark, formats.human_size, sizes, "bigint") == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "102.2 KB", "1024.0 KB", "1.0 MB", "42.0 MB", "41.3 MB", "1024.0 MB",
        "1.00 GB", "5.00 GB", None,
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, settings, zone):
    settings({"spark.sql.session.timeZone": zone})
    assert apply(spark, formats.format_mtime, [1735689600000, 0, 1710054000000, None], "bigint") == [
        "2025-01-01 00:00", "1970-01-01 00:00", "2024-03-10 07:00", None,
    ]
    texts = [
        "2025-01-01T00:00:00.000GMT", "2025-01-01T00:00:00.000Z", "2025-01-01T00:00:00.000+00:00",
        "2025-01-01T02:00:00+02:00", "2025-01-01T00:00:00", "2025-01-01T00:00:00.000EST",
        "1735689600000", " 1735689600000 ",
    ]
    assert apply(spark, formats.parse_spark_time, texts) == [1735689600000] * len(texts)
    moments = apply(spark, formats.utc_millis, [dt.datetime(2025, 1, 1)], "timestamp_ntz")
    assert moments == [1735689600000]


def test_times_that_cannot_be_read_are_null(spark):
    texts = ["garbage", "", "2025-01-01", "2025-13-01T00:00:00Z", "99999999999999999999", None]
    assert apply(spark, formats.parse_spark_time, texts) == [None] * len(texts)
    assert apply(spark, formats.parse_spark_time, [1735689600000, None], "bigint") == [1735689600000, None]


def test_hdfs_path(spark):
    uris = ["hdfs://nn:8020/user/x", "hdfs://nn", "hdfs://nn/", "/user/x", "s3://bucket/key", "hdfs:///x"]
    assert apply(spark, formats.hdfs_path, uris) == ["/user/x", "/", "/", "/user/x", "s3://bucket/key", "/x"]


def test_one_line_and_history_line(spark):
    assert apply(spark, formats.one_line, ["SELECT 1\nFROM t\n", None]) == ["SELECT 1 FROM t ", None]
    stamp = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    assert apply(spark, lambda c: formats.history_line(stamp, c), ["a\nb"]) == ["[2026-01-01 12:00:00] a b"]


def test_split_key_value(spark):
    pairs = ["a=1", "a=b=c", "=x", "a=", "none", "", None]
    assert [tuple(r) for r in apply(spark, formats.split_key_value, pairs)] == [
        ("a", "1", True), ("a", "b=c", True), ("", "x", True), ("a", "", True),
        (None, None, False), (None, None, False), (None, None, False),
    ]


def test_short_name_and_glyph(spark):
    assert apply(spark, formats.short_name, ["x" * 22, "x" * 23]) == ["x" * 22, "x" * 21 + "…"]
    assert apply(spark, formats.status_glyph, ["complete", "ACTIVE", "Failed", "PENDING", None]) == ["█", "▓", "█", "░", "░"]


def test_csv_quotes_only_where_needed(spark, tmp_path):
    df = spark.createDataFrame(
        [("tea", "cold"), ("salt, pepper", "7"), ('a "good" one', "x"), ("two\nrows", "y"), (None, " wide ")],
        "name string, value string",
    ).coalesce(1)
    export(df, str(tmp_path / "out"))
    with open(glob.glob(f"{tmp_path}/out/part*.csv")[0], newline="") as file:
        text = file.read()
    assert text == (
        'name,value\ntea,cold\n"salt, pepper",7\n"a ""good"" one",x\n"two\nrows",y\n, wide \n'
    )
    assert read_csv(spark, str(tmp_path / "out"), df.schema).exceptAll(df).count() == 0


@hypothesis_settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet='a,"\n\t é=\\', min_size=1), min_size=1, max_size=6))
def test_csv_round_trip(spark, tmp_path_factory, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    path = str(tmp_path_factory.mktemp("csv") / "out")
    export(df, path)
    back = {r.i: r.v for r in read_csv(spark, path, df.schema).collect()}
    assert back == dict(enumerate(values))


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string").coalesce(1)
    export(df, str(tmp_path / "json"), "json")
    with open(glob.glob(f"{tmp_path}/json/part*.json")[0]) as file:
        assert file.read().splitlines() == ['{"id":1,"v":null}', '{"id":2,"v":"x"}']
    export(df, str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    export(spark.range(0, 10, 1, 1), str(tmp_path / "cut"), "json", rows_per_file=3)
    assert len(glob.glob(f"{tmp_path}/cut/part*.json")) == 4
    with pytest.raises(ValueError, match="unknown format"):
        export(df, str(tmp_path / "other"), "xml")


def test_render_tsv(spark):
    df = spark.createDataFrame([(1, None, True), (2, "x", None)], "id int, `odd.name` string, b boolean")
    assert [r.line for r in render_tsv(df).collect()] == ["1\tNone\ttrue", "2\tx\tNone"]
    assert render_tsv(df.limit(0)).count() == 0


def test_generated_users(spark):
    as_of = dt.datetime(2026, 1, 1)
    users = generate_users(spark, 10000, 42, as_of)
    assert users.agg(F.count_distinct("username")).first()[0] == 10000
    low, high = users.agg(F.min("age"), F.max("age")).first()
    assert (low, high) == (18, 60)
    first, last = users.agg(F.min("registered_at"), F.max("registered_at")).first()
    assert as_of - dt.timedelta(days=365) <= first and last <= as_of
    assert users.exceptAll(generate_users(spark, 10000, 42, as_of)).count() == 0
    buckets = aggregates.bucket_histogram(users, "age", 10).collect()
    assert [r.bucket for r in buckets] == [10, 20, 30, 40, 50, 60]
    assert sum(r.row_count for r in buckets) == 10000


def test_average_and_histogram(spark):
    df = spark.createDataFrame([(49,), (51,), (60,), (None,), (-5,)], "age int")
    assert aggregates.average_over(df, "age", 50).first()["avg_age"] == 55.5
    assert [tuple(r) for r in aggregates.bucket_histogram(df, "age", 10).collect()] == [
        (None, 1), (-10, 1), (40, 1), (50, 1), (60, 1),
    ]


def test_line_total(spark):
    items = spark.sql("SELECT 3 AS quantity, CAST(2.99 AS DECIMAL(10,2)) AS unit_price")
    assert str(aggregates.line_total(items).first().line_total) == "8.97"


def test_checks(spark):
    raw = spark.createDataFrame([(1, "I"), (2, "U"), (2, None), (None, "X")], "id int, op string")
    assert [tuple(r) for r in checks.row_count_check(raw, raw.limit(0)).collect()] == [
        ("not_empty", 0, 1, False), ("same_row_count", 0, 4, False),
    ]
    assert checks.increase_check(raw, raw).first().passed is False
    assert {tuple(r) for r in checks.null_counts(raw, ["id", "op"]).collect()} == {("id", 1), ("op", 1)}
    assert [tuple(r) for r in checks.duplicate_keys(raw, ["id"]).collect()] == [(2, 2)]
    assert [tuple(r) for r in checks.invalid_values(raw, "op", ["I", "U", "D"]).collect()] == [(None, "X")]
    parent = spark.createDataFrame([(2,)], "pk int")
    assert [r.id for r in checks.orphan_rows(raw, parent, {"id": "pk"}).collect()] == [1]
