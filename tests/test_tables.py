"""Write modes, commit log, curation jobs, sync jobs and file care, on files in a temporary folder."""

import datetime as dt
import decimal
import glob
import os
from unittest import mock

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lakewright.operators import files, snapshots
from lakewright.plans import curate, sync
from lakewright.session import ensure_checkpoint_dir, scratch_path
from lakewright.sinks import tables
from lakewright.sources.relational import jdbc_from_dsn, jdbc_options, read_source

NOW = dt.datetime(2026, 1, 10, 12, 0, 0)


def day(back):
    return NOW - dt.timedelta(days=back)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def parts(path):
    return glob.glob(f"{path}/**/*.parquet", recursive=True)


@pytest.fixture
def orders(spark):
    money = decimal.Decimal
    data = [
        (1, 71, "shipped", money("310.25"), day(6), day(5)),
        (2, 72, "pending", money("8.00"), day(2), day(2)),
        (3, 72, "shipped", money("64.75"), day(2), day(0)),
        (4, 73, "returned", money("120.10"), day(8), day(7)),
        (5, 74, "pending", money("0.99"), day(0), day(0)),
    ]
    schema = "id bigint, user_id bigint, status string, total_amount decimal(12,2), created_at timestamp, updated_at timestamp"
    return spark.createDataFrame(data, schema)


def test_append_adds_rows_and_commits(spark, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    for i, label in enumerate(["north", "south", "west"]):
        row = spark.createDataFrame([(i, label, i + 1)], "id bigint, label string, value bigint")
        tables.record_commit(spark, log, "t", tables.append(row, table), day(3 - i))
    assert spark.read.parquet(table).count() == 3
    commits = tables.read_log(spark, log)
    assert rows(snapshots.snapshot_counts(commits)) == [("t", 3)]
    assert rows(snapshots.latest_operation(commits)) == [("t", "append")]


def test_operation_history_shows_every_kind_of_write(spark, tmp_path):
    log = str(tmp_path / "log")
    schema = "id bigint, val string"
    steps = [
        tables.append(spark.createDataFrame([(1, "red")], schema), str(tmp_path / "v1")),
        tables.overwrite(spark.createDataFrame([(1, "blue"), (2, "grey")], schema), str(tmp_path / "v1")),
    ]
    for i, operation in enumerate(steps):
        tables.record_commit(spark, log, "t", operation, day(9 - i))
    v = [str(tmp_path / f"v{i}") for i in range(1, 5)]
    source = spark.createDataFrame([(2, "pink"), (3, "lime")], schema)
    tables.merge_table(spark, v[0], v[1], source, ["id"], [], log, "t", day(7))
    tables.delete_from(spark, v[1], v[2], F.col("id") == 1, [], log, "t", day(6))
    tables.compact_table(spark, v[2], v[3], files.TARGET_BYTES, [], log, "t", day(5))
    history = snapshots.operation_history(tables.read_log(spark, log)).collect()
    assert [r.operation for r in history] == ["append", "overwrite", "overwrite", "delete", "replace"]
    assert rows(spark.read.parquet(v[0])) == [(1, "blue"), (2, "grey")]
    assert rows(spark.read.parquet(v[3])) == [(2, "pink"), (3, "lime")]


def test_recent_snapshots_keeps_the_newest_twenty(spark):
    log = spark.createDataFrame([("t", i, NOW + dt.timedelta(minutes=i), "append") for i in range(30)], tables.LOG_SCHEMA)
    ids = [r.snapshot_id for r in snapshots.recent_snapshots(log).collect()]
    assert ids == list(range(29, 9, -1))


def test_log_that_does_not_exist_is_empty(spark, tmp_path):
    assert tables.read_log(spark, str(tmp_path / "none")).count() == 0


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.sql("SELECT id, id % 3 AS p FROM range(9)"), path, ["p"])
    tables.overwrite(spark.sql("SELECT 100L AS id, 1L AS p"), path, ["p"], dynamic=True)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 3, 5, 6, 8, 100]
    tables.overwrite(spark.sql("SELECT 7L AS id, 2L AS p"), path, ["p"])
    assert [r.id for r in spark.read.parquet(path).collect()] == [7]


def test_replace_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    with pytest.raises(AnalysisException):
        tables.replace_table(spark.range(3), path)


def test_partitioned_write_gives_one_file_per_small_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(0, 4000, 1, 8).withColumn("p", F.col("id") % 10), path, ["p"])
    assert len(parts(path)) == 10


def test_partitioned_write_splits_a_large_partition(spark, settings, tmp_path):
    settings({"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB"})
    path = str(tmp_path / "t")
    hot = F.when(F.col("id") % 50 == 0, F.col("id") % 3).otherwise(F.lit(9))
    tables.replace_table(spark.range(0, 200000, 1, 8).select("id", F.rand(1).alias("v"), hot.alias("p")), path, ["p"])
    assert len(parts(f"{path}/p=9")) > 3
    assert spark.read.parquet(path).count() == 200000


def test_create_if_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.create_if_absent(spark, "made_once", "id BIGINT, day DATE", path, ["day"])
    assert spark.table("made_once").columns == ["id", "day"]
    spark.sql("DROP TABLE made_once")


def test_merge_partitions_rewrites_only_touched_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.sql("SELECT id, id % 4 AS p, 'old' AS v FROM range(40)"), path, ["p"])
    untouched = {f: os.stat(f).st_mtime_ns for f in parts(path) if "p=1" not in f}
    source = spark.sql("SELECT 5L AS id, 1L AS p, 'new' AS v UNION ALL SELECT 101L, 1L, 'new'")
    assert tables.merge_partitions(spark, path, source, ["id", "p"], ["p"]) == "overwrite"
    after = spark.read.parquet(path)
    assert after.count() == 41
    assert sorted(r.id for r in after.filter("v = 'new'").collect()) == [5, 101]
    assert {f: os.stat(f).st_mtime_ns for f in parts(path) if "p=1" not in f} == untouched


def test_merge_partitions_keeps_rows_without_partition_value(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.sql("SELECT id, IF(id % 4 = 3, NULL, id % 4) AS p, 'old' AS v FROM range(40)"), path, ["p"])
    untouched = {f: os.stat(f).st_mtime_ns for f in parts(path) if "p=1" in f}
    source = spark.sql("SELECT 4L AS id, 0L AS p, 'new' AS v UNION ALL SELECT 6L, 2L, 'new' UNION ALL SELECT 900L, NULL, 'new'")
    tables.merge_partitions(spark, path, source, ["id", "p"], ["p"])
    assert rows(spark.read.parquet(path).groupBy("v").count()) == [("new", 3), ("old", 38)]
    assert {f: os.stat(f).st_mtime_ns for f in parts(path) if "p=1" in f} == untouched


def test_full_sync_that_fails_keeps_the_old_rows(spark, orders, tmp_path):
    src, dst, log = (str(tmp_path / n) for n in ("src", "dst", "log"))
    orders.write.parquet(src)
    sync.sync_one(spark, sync.SyncJob("orders", "parquet", {"path": src}, dst), log, NOW)
    bad = sync.SyncJob("orders", "parquet", {"path": src}, dst, query="SELECT IF(id > 3, raise_error('lost'), id) AS id FROM {source}")
    with pytest.raises(Exception, match="lost"):
        sync.sync_one(spark, bad, log, NOW)
    assert spark.read.parquet(dst).count() == 5
    assert not [n for n in os.listdir(tmp_path) if ".old-" in n]


def test_sync_with_keys_replaces_updated_rows_and_takes_equal_marks(spark, tmp_path):
    src, dst, log = (str(tmp_path / n) for n in ("src", "dst", "log"))
    schema = "id bigint, v string, mark bigint"
    job = sync.SyncJob("t", "parquet", {"path": src}, dst, mode="incremental", watermark_column="mark", keys=["id"])
    spark.createDataFrame([(1, "a", 10), (2, "b", None)], schema).write.parquet(src)
    sync.sync_one(spark, job, log, NOW)
    spark.createDataFrame([(1, "a2", 11), (3, "c", 10), (4, "d", 9)], schema).write.mode("overwrite").parquet(src)
    sync.sync_one(spark, job, log, NOW)
    assert rows(spark.read.parquet(dst)) == [(1, "a2", 11), (2, "b", None), (3, "c", 10)]


def test_silver_and_gold_jobs(spark, orders, tmp_path):
    raw, silver, log = (str(tmp_path / n) for n in ("raw", "silver", "log"))
    orders.write.parquet(raw)
    checks = curate.run_silver(spark, raw, silver, log, day(1))
    assert rows(checks) == [("not_empty", 5, 1, True), ("same_row_count", 5, 5, True)]
    assert os.path.isdir(f"{silver}/order_date=2026-01-04")

    expected = [(dt.date(2026, 1, 4), 1, 310.25), (dt.date(2026, 1, 8), 1, 64.75)]
    gold1, gold2, packed = (str(tmp_path / n) for n in ("gold1", "gold2", "packed"))
    first = curate.run_gold(spark, raw, str(tmp_path / "none"), gold1, log, day(0))
    assert all(r.passed for r in first.collect()) and first.count() == 2
    assert rows(spark.read.parquet(gold1).select("order_date", "order_count", "revenue")) == expected
    again = curate.run_gold(spark, raw, gold1, gold2, log, NOW + dt.timedelta(hours=1), compact_to=packed)
    assert all(r.passed for r in again.collect())
    assert rows(spark.read.parquet(packed).select("order_date", "order_count", "revenue")) == expected
    assert rows(snapshots.snapshot_counts(tables.read_log(spark, log))) == [("daily_revenue", 2), ("orders_silver", 1)]


def test_revenue_of_days_without_amounts_is_zero(spark):
    df = spark.createDataFrame([("shipped", None, NOW)], "status string, total_amount decimal(12,2), created_at timestamp")
    assert rows(curate.daily_revenue(df)) == [(dt.date(2026, 1, 10), 1, 0.0)]


def test_full_sync_replaces_and_commits(spark, orders, tmp_path):
    src, dst, log = (str(tmp_path / n) for n in ("src", "dst", "log"))
    orders.write.parquet(src)
    job = sync.SyncJob("orders", "parquet", {"path": src}, dst, query="SELECT id, status FROM {source}")
    for hour in range(2):
        sync.sync_full(spark, [job], log, NOW + dt.timedelta(hours=hour))
    assert spark.read.parquet(dst).columns == ["id", "status"]
    assert spark.read.parquet(dst).count() == 5
    assert [r.operation for r in tables.read_log(spark, log).collect()] == ["overwrite"] * 2


def test_incremental_sync_takes_only_newer_rows(spark, orders, tmp_path):
    src, dst, log = (str(tmp_path / n) for n in ("src", "dst", "log"))
    job = sync.SyncJob("orders", "parquet", {"path": src}, dst, mode="incremental", watermark_column="updated_at")
    orders.filter("id IN (1, 4)").write.parquet(src)
    sync.sync_one(spark, job, log, day(1))
    assert spark.read.parquet(dst).count() == 2
    orders.filter("id NOT IN (1, 4)").write.mode("append").parquet(src)
    for _ in range(2):
        sync.sync_one(spark, job, log, NOW)
        assert sorted(r.id for r in spark.read.parquet(dst).collect()) == [1, 2, 3, 4, 5]


def test_incremental_filter_reaches_the_scan(spark, orders, tmp_path, capsys):
    src = str(tmp_path / "src")
    orders.write.parquet(src)
    source = spark.read.parquet(src)
    sync.incremental_extract(source, source.filter("id = 1"), "updated_at").explain("formatted")
    assert "GreaterThan(updated_at" in capsys.readouterr().out


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string", "decimal(10,2)", "double", "int", "bigint"])
def test_an_empty_target_takes_every_row(spark, kind):
    text = "'2026-01-01'" if kind in ("timestamp", "timestamp_ntz", "date", "string") else "-5"
    source = spark.sql(f"SELECT CAST({text} AS {kind}) AS mark")
    assert sync.incremental_extract(source, source.limit(0), "mark").count() == 1
    assert sync.incremental_extract(source, source, "mark").count() == 0


def test_incremental_upsert(spark, tmp_path):
    schema = "id bigint, v string, mark bigint"
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], schema)
    source = spark.createDataFrame([(1, "stale", 5), (2, "b2", 30), (3, "c", 25)], schema)
    path = str(tmp_path / "new")
    sync.incremental_upsert(source, target, ["id"], "mark", path)
    assert rows(spark.read.parquet(path)) == [(1, "a", 10), (2, "b2", 30), (3, "c", 25)]


def test_sync_jobs_are_checked():
    with pytest.raises(ValueError, match="watermark"):
        sync.SyncJob("x", "parquet", {}, "y", mode="incremental")
    with pytest.raises(ValueError, match="mode"):
        sync.SyncJob("x", "parquet", {}, "y", mode="other")


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "SELECT 1", fetch_size=1000)
    assert plain == {"url": "jdbc:x", "fetchsize": "1000", "query": "SELECT 1"}
    cut = jdbc_options("jdbc:x", "SELECT id FROM t", None, "id", (1, 900), 9)
    assert cut["dbtable"] == "(SELECT id FROM t) q" and "query" not in cut
    assert (cut["partitionColumn"], cut["lowerBound"], cut["upperBound"], cut["numPartitions"]) == ("id", "1", "900", "9")
    cents = jdbc_options("jdbc:x", "SELECT 1", None, "amount", (decimal.Decimal("1.25"), decimal.Decimal("9.01")), 2)
    assert (cents["lowerBound"], cents["upperBound"]) == ("1", "10")
    days = jdbc_options("jdbc:x", "SELECT 1", None, "day", (dt.date(2024, 1, 2), dt.date(2024, 3, 4)), 2)
    assert (days["lowerBound"], days["upperBound"]) == ("2024-01-02", "2024-03-04")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "SELECT 1", partition_column="id")


def test_sync_spec():
    spec = {
        "sources": {"pg": {"type": "postgres", "dsn": "host=db port=5432 dbname=shop user=app password=x sslmode=disable"}},
        "sync_jobs": [
            {"name": "orders", "source": "pg", "destination": "warehouse", "namespace": "demo", "table": "orders",
             "sql": "SELECT id FROM orders\n", "watermark_column": None, "batch_size": 1000, "mode": "full",
             "predicates": ["id < 10", "id >= 10"], "keys": ["id"]},
        ],
    }
    (job,) = sync.jobs_from_spec(spec, "/lake/")
    assert job.options["url"] == "jdbc:postgresql://db:5432/shop?sslmode=disable"
    assert (job.options["user"], job.options["password"]) == ("app", "x")
    assert (job.predicates, job.keys) == (("id < 10", "id >= 10"), ("id",))
    assert (job.target, job.query, job.batch_size, job.mode) == ("/lake/demo/orders", "SELECT id FROM orders", 1000, "full")
    with pytest.raises(ValueError, match="source type"):
        jdbc_from_dsn("other", "")


def test_file_source_without_query(spark, orders, tmp_path):
    orders.write.parquet(str(tmp_path / "src"))
    assert read_source(spark, "parquet", {"path": str(tmp_path / "src")}).count() == 5


def test_compaction_packs_small_files(spark, tmp_path):
    src, dst = str(tmp_path / "small"), str(tmp_path / "packed")
    for i in range(5):
        tables.append(spark.createDataFrame([(i, f"load {i}")], "id bigint, value string"), src)
    before = len(parts(src))
    packed = files.compact_files(spark, src, dst)
    assert before >= 5 and len(parts(dst)) == 1
    assert rows(packed) == [(i, f"load {i}") for i in range(5)]


def test_compaction_uses_the_settings_of_the_session(spark, settings, tmp_path):
    settings({"spark.sql.parquet.compression.codec": "zstd"})
    spark.range(10).write.parquet(str(tmp_path / "small"))
    files.compact_files(spark, str(tmp_path / "small"), str(tmp_path / "packed"))
    assert all(f.endswith(".zstd.parquet") for f in parts(str(tmp_path / "packed")))


def test_compaction_keeps_to_the_target_size(spark, tmp_path):
    src, dst = str(tmp_path / "small"), str(tmp_path / "packed")
    spark.range(0, 200000, 1, 40).withColumn("v", F.rand(1)).write.parquet(src)
    target = sum(os.path.getsize(f) for f in parts(src)) // 4
    assert files.compact_files(spark, src, dst, target_bytes=target).count() == 200000
    assert 4 <= len(parts(dst)) <= 6
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "0"


def test_compaction_spreads_a_large_partition(spark, tmp_path):
    src, dst = str(tmp_path / "small"), str(tmp_path / "packed")
    hot = F.when(F.col("id") % 20 == 0, F.col("id") % 3).otherwise(F.lit(9))
    table = spark.range(0, 200000, 1, 20).select("id", F.rand(1).alias("v"), hot.alias("p"))
    table.write.partitionBy("p").parquet(src)
    size = sum(os.path.getsize(f) for f in parts(f"{src}/p=9"))
    packed = files.compact_files(spark, src, dst, target_bytes=size // 4)
    assert packed.count() == 200000 and packed.select("id").distinct().count() == 200000
    assert 3 <= len(parts(f"{dst}/p=9")) <= 8
    assert len(parts(f"{dst}/p=0")) == 1


def test_compaction_by_partition_sorts_nothing_in_memory(spark, tmp_path):
    src, dst = str(tmp_path / "small"), str(tmp_path / "packed")
    table = spark.range(0, 2000, 1, 4).withColumn("p", F.col("id") % 11)
    table.write.partitionBy("p").parquet(src)
    with files.open_writers(spark):
        assert spark.conf.get(files.WRITERS_SETTING) == str(files.OPEN_WRITERS)
    assert spark.conf.get(files.WRITERS_SETTING, "0") == "0"
    with mock.patch.object(files, "open_writers", wraps=files.open_writers) as opened:
        packed = files.compact_files(spark, src, dst)
    assert opened.called
    # More values than open files, none lost.
    assert rows(packed.groupBy("p").count()) == rows(table.groupBy("p").count())


def test_inventories(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 5).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    found = files.file_inventory(spark, path)
    assert found.count() == 10
    assert {r.bytes for r in found.collect()} == {os.path.getsize(f) for f in parts(path)}
    assert rows(files.file_rows(spark, path).groupBy("row_count").count()) == [(10, 10)]
    per_partition = files.partition_files(spark, path, ["p"])
    assert rows(per_partition.select("p", "files", "row_count")) == [(0, 5, 50), (1, 5, 50)]
    assert per_partition.agg(F.sum("bytes")).first()[0] == sum(os.path.getsize(f) for f in parts(path))


def test_inventory_reads_no_content(spark, tmp_path, capsys):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    files.file_inventory(spark, str(tmp_path / "t")).explain("formatted")
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[1].split("\n")[0]


def test_listing(spark):
    schema = (
        "pathSuffix string, type string, length bigint, owner string, modificationTime bigint, "
        "permission string, replication int, blockSize bigint"
    )
    status = spark.createDataFrame(
        [
            ("ledger.orc", "FILE", 3 * 1048576, "ana", 1719792000000, "640", 2, 134217728),
            ("notes.txt", "FILE", 1536, "ana", 1719792000000, "640", 2, 134217728),
            ("old", "DIRECTORY", 0, "ana", 1719792000000, "750", 0, 0),
            (".draft", "FILE", 5, "ana", 1719792000000, "640", 2, 134217728),
        ],
        schema,
    )
    assert [tuple(r) for r in files.list_status(status).orderBy("name").collect()] == [
        ("-", "ledger.orc", "3.0 MB", "2024-07-01 00:00", "ana", "640"),
        ("-", "notes.txt", "1.5 KB", "2024-07-01 00:00", "ana", "640"),
        ("d", "old", "-", "2024-07-01 00:00", "ana", "750"),
    ]
    longer = files.list_status(status, include_hidden=True, long=True).orderBy("name").collect()
    assert (longer[0]["name"], longer[0]["perms"]) == (".draft", "640 r=2")


def test_inventory_of_a_status_table_shows_hidden_files(spark):
    status = spark.createDataFrame(
        [("t/_temporary/a", "FILE", 7, 1719792000000), ("t/.b", "FILE", 0, 1719792000000), ("t/c", "DIRECTORY", 0, 1719792000000)],
        "path string, type string, length bigint, modificationTime bigint",
    )
    assert sorted((r.path, r.bytes) for r in files.inventory_of(status).collect()) == [("t/.b", 0), ("t/_temporary/a", 7)]


def test_vacuum_candidates(spark):
    found = spark.createDataFrame(
        [("a", day(10)), ("b", day(10)), ("c", day(2)), ("d", NOW - dt.timedelta(hours=168))],
        "path string, modified timestamp",
    )
    live = spark.createDataFrame([("b",), ("b",)], "path string")
    assert [r.path for r in files.vacuum_candidates(found, live, F.lit(NOW)).collect()] == ["a"]
    recent = files.vacuum_candidates(found, live, F.lit(NOW), retain_hours=24)
    assert sorted(r.path for r in recent.collect()) == ["a", "c", "d"]


def test_scratch_paths_lie_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    if shared:
        assert first.startswith(shared.rstrip("/") + "/")


def test_a_session_without_checkpoint_folder_gets_one_only_locally():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        applicationId = "app-1"

        def __getattr__(self, name):
            if name in ("_jvm", "_jsc"):
                return mock.MagicMock()
            raise AttributeError(name)

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), Context(master)

    local = Session("local[2]")
    ensure_checkpoint_dir(local)
    assert local.sparkContext.folder and scratch_path(local, "x").startswith(local.sparkContext.folder)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session("yarn"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session("local-cluster[2,1,1024]"), "x")


def test_keyed_sync_rewrites_only_partitions_of_new_marks(spark, tmp_path):
    src, dst, log = (str(tmp_path / n) for n in ("src", "dst", "log"))
    schema = "id bigint, p string, mark bigint"
    data = [(i, f"p{i % 3}", i) for i in range(9)]
    spark.createDataFrame(data, schema).write.parquet(src)
    job = sync.SyncJob(
        "t", "parquet", {"path": src}, dst, mode="incremental", watermark_column="mark", keys=["id", "p"], partition_by=["p"]
    )
    sync.sync_one(spark, job, log, NOW)
    before = set(parts(dst))
    spark.createDataFrame([(1, "p1", 20), (30, "p2", 21)], schema).write.mode("append").parquet(src)
    sync.sync_one(spark, job, log, NOW)
    want = [r for r in data if r[0] != 1] + [(1, "p1", 20), (30, "p2", 21)]
    assert rows(spark.read.parquet(dst).select("id", "p", "mark")) == sorted(want, key=repr)
    same = before & set(parts(dst))
    assert same and all("p=p0" in path for path in same)
    sync.sync_one(spark, job, log, NOW)
    assert rows(spark.read.parquet(dst).select("id", "p", "mark")) == sorted(want, key=repr)
