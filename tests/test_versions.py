"""Versioned tables: commits, conflicts, failures before the commit, moved keys, untouched files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from fieldlens.sources.versions import Conflict, VersionedTable

SCHEMA = "period string, k long, v string"


def digests(table):
    return {p: hashlib.sha256(open(f"{table.root}/{p}", "rb").read()).hexdigest() for p in table.current().files}


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def table_of(spark, tmp_path, data, name="t", partition_cols=("period",)):
    table = VersionedTable(spark, f"{tmp_path}/{name}")
    table.replace(spark.createDataFrame(data, SCHEMA), partition_cols=partition_cols)
    return table


def test_a_moved_key_leaves_no_copy_and_other_files_stay(spark, tmp_path):
    data = [(f"2024-{m:02d} x", 100 * m + i, "a") for m in range(1, 6) for i in range(20)]
    table = table_of(spark, tmp_path, data)
    before = digests(table)
    changes = spark.createDataFrame([("2024-04 x", 105, "moved", 1), ("2024-04 x", 105, "later", 2),
                                     ("2024-02 x", 201, "same place", 1), ("2025-01", 999, "new", 1)],
                                    SCHEMA + ", seq int")
    table.upsert(changes, ["k"], "seq", ["period"])
    want = {r[1]: r for r in data} | {105: ("2024-04 x", 105, "later"), 201: ("2024-02 x", 201, "same place"),
                                      999: ("2025-01", 999, "new")}
    assert rows(table) == sorted(want.values())
    after = digests(table)
    kept = {p for p in before if "_period=2024-01" not in p and "_period=2024-02" not in p}
    assert kept and kept <= set(after) and all(after[p] == before[p] for p in kept)
    assert not any(p in after for p in before if p not in kept)
    assert rows(table, 1) == sorted(data)  # the old version can still be read
    assert all(len({r.period for r in table.read(files=[p]).collect()}) == 1 for p in after)


def test_null_keys_and_empty_tables(spark, tmp_path):
    table = table_of(spark, tmp_path, [("p", None, "a"), ("p", 1, "b")])
    changes = spark.createDataFrame([("q", None, "c", 1)], SCHEMA + ", seq int")
    table.upsert(changes, ["k"], "seq", ["period"], null_safe=True)
    assert set(map(tuple, table.read().collect())) == {("p", 1, "b"), ("q", None, "c")}
    empty = table_of(spark, tmp_path, [], "empty")
    assert rows(empty) == []
    empty.upsert(spark.createDataFrame([("p", 1, "a", 1)], SCHEMA + ", seq int"), ["k"], "seq", ["period"])
    assert rows(empty) == [("p", 1, "a")]
    with pytest.raises(ValueError, match="no version"):
        VersionedTable(spark, f"{tmp_path}/none").read()


def test_replacing_a_source_leaves_the_others(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x")], SCHEMA)
    two = spark.createDataFrame([("b", 1, "x")], SCHEMA)
    table.replace(one, "one")
    table.replace(two, "two")
    before = digests(table)
    table.replace(one.where("k = 2"), "one", note={"run": "3"})
    assert rows(table) == [("a", 2, "x"), ("b", 1, "x")] and table.current().note == {"run": "3"}
    assert [p for p, g in table.current().files.items() if g == "two"] == [
        p for p in before if digests(table).get(p) == before[p]]
    with pytest.raises(ValueError, match="columns differ"):
        table.replace(two.drop("v"), "two")


def test_a_failure_before_the_commit_leaves_the_old_version(spark, tmp_path):
    table = table_of(spark, tmp_path, [("a", 1, "x"), ("a", 2, "y")])
    broken = table.read().withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert rows(table) == [("a", 1, "x"), ("a", 2, "y")] and table.versions() == [1]


def test_of_two_writers_one_wins(spark, tmp_path):
    table = table_of(spark, tmp_path, [("a", 1, "x")])
    base = table.current()
    add = table.write_files(spark.createDataFrame([("b", 2, "y")], SCHEMA))
    table.commit(base, base.schema, dict.fromkeys(add, ""))
    with pytest.raises(Conflict):
        table.commit(base, base.schema, {}, list(base.files))
    assert rows(table) == [("a", 1, "x"), ("b", 2, "y")]
    assert not [f for f in os.listdir(f"{table.root}/_versions") if f.startswith("tmp")]


def test_expire_deletes_only_what_no_kept_version_lists(spark, tmp_path):
    table = table_of(spark, tmp_path, [("a", 1, "x"), ("b", 2, "y")])
    for n in range(3):
        table.upsert(spark.createDataFrame([("a", 1, f"v{n}", n)], SCHEMA + ", seq int"), ["k"], "seq", ["period"])
    gone = table.expire(keep=2)
    assert gone and table.versions() == [3, 4] and rows(table) == [("a", 1, "v2"), ("b", 2, "y")]
    assert rows(table, 3) == [("a", 1, "v1"), ("b", 2, "y")]
    assert not any(os.path.exists(f"{table.root}/{p}") for p in gone)


def test_import_of_two_files_swaps_one_source(spark, tmp_path):
    import csv

    from test_ingest import _masters, _row

    from fieldlens.plans import ingest
    from fieldlens.schema import SHEET_HEADERS

    def write(name, rows):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as fh:
            w = csv.writer(fh)
            w.writerow(SHEET_HEADERS)
            w.writerows([list(r.values()) for r in rows])
        return str(tmp_path / name)
    one, two = _row(), {**_row(), "Tháng": "13"}
    paths = [write("a.csv", [one, two]), write("b.csv", [one])]
    table = VersionedTable(spark, f"{tmp_path}/sheet")
    T = _masters(spark)
    first = ingest.import_files_to_table(table, paths, T, "north", "run-1")
    assert {(r.source_file.rsplit("/", 1)[1], r.source_row, r.source_id) for r in first.sheet.collect()} == {
        ("a.csv", 2, "north"), ("b.csv", 2, "north")}
    assert [r.change for r in first.diff.collect()] == ["inserted"] * 2 and first.rejected.count() == 1
    ingest.import_files_to_table(table, paths[1:], T, "south", "run-2")
    again = ingest.import_files_to_table(table, paths[:1], T, "north", "run-3")
    assert sorted(r.change for r in again.diff.collect()) == ["deleted", "unchanged"]
    assert sorted((r.source_id, r.batch_id) for r in again.sheet.collect()) == [("north", "run-3"), ("south", "run-2")]
    with pytest.raises(ValueError, match="rejected rows"):
        ingest.import_files_to_table(table, paths, T, "north", "run-4", strict=True)
    assert table.current().note == {"run": "run-3"}
