"""Tables with a log of file changes: writes that cost what they change, compaction, vacuum."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lakewright.operators.files import hidden_files, pack_files
from lakewright.sinks import versions
from lakewright.sinks.versions import FileTable

NOW = dt.datetime(2030, 1, 10, 12, 0, 0)
SCHEMA = "id bigint, part string, value double"


def at(hour):
    return NOW + dt.timedelta(hours=hour)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def data(spark, ids, value=1.0, parts=4):
    return spark.createDataFrame([(i, f"p {i % parts}/1%", value) for i in ids], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    made = FileTable(str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ("part",))
    versions.append_files(spark, made, data(spark, range(40)), at(0))
    return made


def test_append_and_overwrite(spark, table):
    assert rows(versions.read_table(spark, table)) == rows(data(spark, range(40)))
    done = versions.append_files(spark, table, data(spark, range(40, 44)), at(1))
    assert (done.commit_no, done.removed, done.added, done.before) == (2, 0, 4, 4)
    done = versions.overwrite_files(spark, table, data(spark, range(3)), at(2))
    assert (done.removed, done.added) == (8, 3)
    assert rows(versions.read_table(spark, table)) == rows(data(spark, range(3)))
    assert rows(versions.read_table(spark, table, 2)) == rows(data(spark, range(44)))
    assert versions.read_table(spark, table, 0).count() == 0


def test_upsert_rewrites_only_files_with_a_key(spark, table):
    source = spark.createDataFrame([(4, "p 0/1%", 7.0), (8, "p 0/1%", 8.0), (100, "p 3/1%", 9.0), (None, "p 3/1%", 1.0)], SCHEMA)
    done = versions.upsert_files(spark, table, source, ["id"], at(1))
    assert (done.removed, done.before) == (1, 4)
    want = {(i, f"p {i % 4}/1%"): 1.0 for i in range(40)} | {(4, "p 0/1%"): 7.0, (8, "p 0/1%"): 8.0, (100, "p 3/1%"): 9.0, (None, "p 3/1%"): 1.0}
    assert rows(versions.read_table(spark, table)) == sorted([(*k, v) for k, v in want.items()], key=repr)
    changes = versions.read_changes(spark, table)
    untouched = {r.path for r in versions.live_files(changes, 1).collect()} & {r.path for r in versions.live_files(changes).collect()}
    assert len(untouched) == 3
    again = versions.upsert_files(spark, table, source.dropna(subset=["id"]), ["id", "part"], at(2))
    assert again.removed == 2
    assert rows(versions.read_table(spark, table)) == sorted([(*k, v) for k, v in want.items()], key=repr)


def test_upsert_moves_a_row_to_its_new_partition_and_sets_listed_columns(spark, table):
    source = spark.createDataFrame([(4, "p 1/1%", 7.0)], SCHEMA)
    versions.upsert_files(spark, table, source, ["id"], at(1), set_cols=["part"])
    found = [tuple(r) for r in versions.read_table(spark, table).where("id = 4").collect()]
    assert found == [(4, "p 1/1%", 1.0)] and versions.read_table(spark, table).count() == 40


def test_upsert_into_nothing_and_of_nothing(spark, tmp_path):
    made = FileTable(str(tmp_path / "new"), spark.createDataFrame([], SCHEMA).schema)
    assert versions.read_table(spark, made).count() == 0
    versions.upsert_files(spark, made, data(spark, range(3)), ["id"], at(0))
    done = versions.upsert_files(spark, made, data(spark, []), ["id"], at(1))
    assert (done.removed, done.added) == (0, 0)
    assert rows(versions.read_table(spark, made)) == rows(data(spark, range(3)))


def test_many_source_rows_for_one_target_row_fail_and_leave_the_table(spark, table):
    source = spark.createDataFrame([(4, "p 0/1%", 7.0), (4, "p 0/1%", 8.0)], SCHEMA)
    with pytest.raises(Exception, match="several source rows"):
        versions.upsert_files(spark, table, source, ["id"], at(1))
    assert rows(versions.read_table(spark, table)) == rows(data(spark, range(40)))


def test_delete_drops_whole_files_and_rewrites_others(spark, table):
    done = versions.delete_files(spark, table, (F.col("id") % 4 == 0) | (F.col("id") == 1), at(1))
    assert (done.removed, done.added) == (2, 1)
    assert rows(versions.read_table(spark, table)) == rows(data(spark, [i for i in range(40) if i % 4 and i != 1]))
    nothing = versions.delete_files(spark, table, F.lit(None).cast("boolean"), at(2))
    assert (nothing.removed, nothing.added) == (0, 0)


def test_versions_follow_the_log(spark, table):
    versions.append_files(spark, table, data(spark, range(40, 44)), at(1))
    versions.delete_files(spark, table, F.col("id") >= 40, at(2))
    versions.compact_small(spark, table, at(3))
    got = [tuple(r)[:1] + tuple(r)[2:5] for r in versions.versions(versions.read_changes(spark, table)).orderBy("commit_no").collect()]
    assert got == [(1, "append", 4, 40), (2, "append", 8, 44), (3, "delete", 4, 40), (4, "replace", 4, 40)]


def test_compaction_leaves_right_sized_files_and_all_rows(spark, tmp_path):
    made = FileTable(str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ("part",))
    versions.append_files(spark, made, data(spark, range(20000), parts=2), at(0))
    large = {r.path: r.bytes for r in versions.live_files(versions.read_changes(spark, made)).collect()}
    for n in range(5):
        versions.append_files(spark, made, data(spark, range(30000 + 40 * n, 30040 + 40 * n), parts=2 if n else 3), at(1))
    target = min(large.values())
    before = rows(versions.read_table(spark, made))
    done = versions.compact_small(spark, made, at(2), target_bytes=target)
    after = {r.path: r.bytes for r in versions.live_files(versions.read_changes(spark, made)).collect()}
    assert set(large) <= set(after)
    assert (done.removed, done.added) == (10, 2) and len(after) == 2 + 2 + 1
    assert rows(versions.read_table(spark, made)) == before
    assert versions.compact_small(spark, made, at(3), target_bytes=target).removed == 0


def test_packing_fills_bins_first_fit_decreasing(spark):
    rng = random.Random(1)
    data = [(f"p{rng.randrange(3)}", f"f{i}", rng.randrange(1, 60)) for i in range(400)] + [(None, "n", None)]
    files = spark.createDataFrame(data, "partition string, path string, bytes bigint")
    got = {r.path: (r.partition, r.bin, r.files) for r in pack_files(files, 100).collect()}
    assert set(got) == {d[1] for d in data}
    for part in ("p0", "p1", "p2", ""):
        room, want = [], {}
        for size, path in sorted([(-(b or 0), f) for p, f, b in data if (p or "") == part]):
            place = next((n for n, left in enumerate(room) if left >= -size), len(room))
            if place == len(room):
                room.append(100)
            room[place] += size
            want[path] = place
        assert {f: int(got[f][1].split("-")[1]) for f in want} == want
    lots = pack_files(files, 100, chunk=20).collect()
    held = {}
    for r in lots:
        held.setdefault((r.partition, r.bin), []).append(r.bytes)
    assert len(lots) == 401 and all(sum(b) <= 100 for b in held.values())
    assert len(held) <= 1.3 * len({v[:2] for v in got.values()}) + 20


def test_vacuum_knows_live_removed_unknown_and_temporary_files(spark, table):
    versions.delete_files(spark, table, F.col("id") % 4 == 0, at(1))
    versions.upsert_files(spark, table, data(spark, [1], 5.0), ["id"], at(500))
    data(spark, [7]).write.parquet(f"{table.data}/_commit=lost")
    left = f"{table.data}/_commit=lost/_temporary/0/_temporary/attempt_1/part=x"
    os.makedirs(left)
    with open(f"{left}/part-0.parquet", "w") as out:
        out.write("half")
    long_ago = dt.datetime(2029, 1, 1).timestamp()
    for file in glob.glob(f"{table.data}/**/*", recursive=True, include_hidden=True):
        if os.path.isfile(file):
            os.utime(file, (long_ago, long_ago))
    found = versions.vacuum_files(spark, table, at(501)).collect()
    kinds = {}
    for r in found:
        if r.path.endswith(".parquet"):
            kinds.setdefault(r.reason, []).append(r.path)
    assert {k: len(v) for k, v in kinds.items()} == {"removed": 1, "unknown": len(kinds["unknown"]), "temporary": 1}
    assert all("_commit=lost" in p for p in kinds["unknown"] + kinds["temporary"])
    for r in found:
        os.remove(r.path.removeprefix("file:"))
    assert versions.read_table(spark, table).count() == 30
    assert versions.read_table(spark, table, 2).where("value = 5").count() == 0
    later = versions.vacuum_files(spark, table, at(900)).where("reason = 'removed'").collect()
    assert len([r for r in later if r.path.endswith(".parquet")]) == 1


def test_young_files_are_no_candidates(spark, table):
    versions.delete_files(spark, table, F.col("id") % 4 == 0, dt.datetime.now())
    assert versions.vacuum_files(spark, table, dt.datetime.now()).count() == 0


def test_hidden_files_of_nothing(spark, tmp_path):
    assert hidden_files(spark, str(tmp_path)).count() == 0
