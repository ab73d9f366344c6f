from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from cohortry.session import rows_up_to, spread
from cohortry.sources import codelists, logs, relational, stages
from cohortry.sources.configs import read_configs


def test_query_with_values(spark):
    assert relational.query(spark, "select :a + 1 as x", {"a": 2}).first()["x"] == 3
    assert relational.query(spark, "select ? as x", [5]).first()["x"] == 5
    assert relational.query(spark, "select 1 as x").first()["x"] == 1


def test_row_iterators(spark):
    df = spark.range(0, 250, numPartitions=3)
    chunks = list(relational.row_chunks(df, 100))
    assert [len(chunk) for chunk in chunks] == [100, 100, 50]
    assert [row["id"] for chunk in chunks for row in chunk] == list(range(250))
    assert sum(1 for _ in relational.rows(df)) == 250
    assert list(relational.row_chunks(df.limit(0))) == []


def test_key_ranges_lose_no_key(spark):
    keys = spark.createDataFrame([("0",), ("999",), ("2000",), ("x",), (None,)], "id string")
    ranges = relational.key_ranges(keys, "id")
    assert (ranges.lowest, ranges.highest, ranges.count) == (0, 2001, 3)
    options = relational.jdbc_options("jdbc:x", sql="select 1", ranges=ranges)
    assert options["dbtable"] == "(select 1) q"
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "3")
    assert relational.max_key(keys, "id").first()["max_id"] == 2000
    assert relational.key_ranges(keys.where("id is null"), "id").count == 1
    with pytest.raises(ValueError):
        relational.jdbc_options("jdbc:x")


def test_key_between(spark):
    keys = spark.createDataFrame([("9",), ("10",), ("20",), ("x",)], "id string")
    assert rows_of(keys.where(relational.key_between("id", 9, 20))) == [("10",), ("9",)]


def test_tables(spark):
    assert stages.create_if_absent(spark, "made", lambda: spark.range(3))
    assert stages.table_exists(spark, "made")
    assert not stages.create_if_absent(spark, "made", lambda: spark.range(9), "insert into made values (7)")
    relational.append_table(spark.range(10, 12), "made")
    assert relational.execute(spark, "insert into made values (:x)", {"x": 99})
    assert sorted(row["id"] for row in spark.table("made").collect()) == [0, 1, 2, 7, 10, 11, 99]
    assert stages.column_names(spark, "made") == ["id"]
    spark.sql("drop table made")
    assert not stages.table_exists(spark, "made")


def test_stage_is_built_once(spark, tmp_path):
    path, built = str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return spark.range(5)

    assert stages.materialise(spark, path, build).count() == 5
    assert stages.materialise(spark, path, build).count() == 5
    assert len(built) == 1
    (tmp_path / "stage" / "_SUCCESS").rename(tmp_path / "marker")
    assert stages.materialise(spark, path, build).count() == 5
    assert len(built) == 2


def test_files(spark, tmp_path):
    relational.append_files(spark.range(3), str(tmp_path / "p"))
    relational.append_files(spark.range(2), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    relational.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "c"))
    assert rows_of(spark.read.csv(str(tmp_path / "c"), header=True)) == [("a", "1")]


def test_code_list_files(spark, tmp_path):
    (tmp_path / "dx.csv").write_text("Bipolar (I/II),Mood\n303.90,296.20\n,296.30\n")
    (tmp_path / "sud.csv").write_text("Alcohol\n303.90\n305.00\n")
    (tmp_path / "empty.csv").write_text("None\n")
    read = codelists.CodeList.read(spark, {"dx": str(tmp_path / "dx.csv"), "sud": str(tmp_path / "sud.csv")})
    expected = [
        ("dx", "bipolar_", "303.90"), ("dx", "mood", "296.20"), ("dx", "mood", "296.30"),
        ("sud", "alcohol", "303.90"), ("sud", "alcohol", "305.00"),
    ]
    assert rows_of(read.codes) == expected
    assert list(read.known) == expected
    assert read.names == ["bipolar_", "mood", "alcohol"]
    assert read.headers["bipolar_"] == "Bipolar (I/II)"
    assert codelists.CodeList.read(spark, {"dx": str(tmp_path / "dx.csv")}, few=2).known is None
    assert codelists.CodeList.read(spark, {"dx": str(tmp_path / "empty.csv")}).known == ()


def test_category_map_file(spark, tmp_path):
    (tmp_path / "sex.csv").write_text("value,category\n0,F\n1,M\n9,\n")
    found = codelists.read_category_map(spark, str(tmp_path / "sex.csv"))
    assert rows_of(found) == [("0", "F"), ("1", "M"), ("9", None)]


def test_latest_log(spark, tmp_path):
    (tmp_path / "2020-01-01.log").write_text("old\n")
    (tmp_path / "2020-02-01.log").write_text("a - b - INFO - c - d\nplain\n")
    (tmp_path / "2020-03-01.txt").write_text("no log\n")
    lines = logs.latest_log(spark, str(tmp_path))
    assert sorted(row["value"] for row in lines.collect()) == ["a - b - INFO - c - d", "plain"]
    parsed = lines.select(*logs.log_fields(F.col("value")))
    assert rows_of(parsed) == [("a", "b", "INFO", "c - d"), ("plain", None, None, None)]


def test_configs(spark, tmp_path):
    (tmp_path / "deeper").mkdir()
    (tmp_path / "one.json").write_text('{"inputs": {}}')
    (tmp_path / "deeper" / "two.json").write_text('{"inputs": {}}')
    assert [row["module"] for row in read_configs(spark, str(tmp_path)).collect()] == ["one"]
    assert sorted(row["module"] for row in read_configs(spark, str(tmp_path), recurse=True).collect()) == ["one", "two"]


def test_spread_adds_tasks_only_where_they_are_few(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores + 3)
    assert spread(many) is many


def test_large_code_list_stays_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(codelists, "FEW_CODES", 1)
    made = codelists.CodeList.of(spark, {"dx": {"A": ["1", "2"]}})
    assert made.known is None and made.codes.count() == 2


def test_rows_up_to(spark):
    assert len(rows_up_to(spark.range(5), 5)) == 5
    assert rows_up_to(spark.range(6), 5) is None


def test_stage_of_another_study_is_built_anew(spark, tmp_path):
    path = str(tmp_path / "marked")
    for mark, n in (("a", 1), ("a", 2), ("b", 3)):
        made = stages.materialise(spark, path, lambda n=n: spark.range(n), mark)
        assert made.count() == (3 if mark == "b" else 1)


def test_identity_sees_filters_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id % 3 as kind").write.parquet(path)

    def read():
        return spark.read.parquet(path)

    plain = stages.identity(read())
    assert plain == stages.identity(read())
    others = [read().where("kind = 1"), read().where("kind = 2"), read().limit(5), read().limit(6), read().select("id")]
    assert len({plain, *map(stages.identity, others)}) == 6
    spark.range(20).selectExpr("id", "id % 3 as kind").write.mode("overwrite").parquet(path)
    assert stages.identity(read()) != plain
    local = [spark.createDataFrame(rows, "a int, b string") for rows in ([(1, "x"), (2, "y")], [(2, "y"), (1, "x")], [(1, "x"), (2, "z")])]
    marks = [stages.identity(df) for df in local]
    assert marks[0] == marks[1] != marks[2]


def test_run_is_appended_once(spark):
    for run, rows in (("a", 3), ("b", 2), ("a", 4)):
        stages.append_once(spark.range(rows).selectExpr("id", "'x' as word"), "runs", run)
    assert {r["run_id"]: r["count"] for r in spark.table("runs").groupBy("run_id").count().collect()} == {"a": 4, "b": 2}
    with pytest.raises(ValueError):
        stages.append_once(spark.range(1), "runs", "it's")
    spark.sql("drop table runs")


def test_versions_behind_a_view(spark):
    first = stages.publish(spark.range(3), "seen")
    before = spark.table("seen")
    second = stages.publish(spark.range(5).withColumnRenamed("id", "number"), "seen")
    assert stages.column_names(spark, "seen") == ["number"] and spark.table("seen").count() == 5
    assert before.count() == 3 and stages.versions(spark, "seen") == sorted([first, second])
    stages.retire(spark, "seen", second)
    assert stages.versions(spark, "seen") == [second]
    spark.sql("drop view seen")
    stages.retire(spark, "seen", "")


def test_balanced_ranges_lose_no_key(spark):
    keys = spark.range(1000).selectExpr("cast(if(id < 900, id, id * 1000000) as string) as id").unionByName(spark.createDataFrame([("x",), (None,)], "id string"))
    bounds = relational.balanced_bounds(keys, "id", 8)
    counts = {r["n"]: r["count"] for r in keys.groupBy(relational.range_number("id", bounds).alias("n")).count().collect()}
    assert len(counts) == 8 and sum(counts.values()) == 1002 and max(counts.values()) <= 2 * 1002 / 8
    numbers = spark.range(1000).selectExpr("if(id < 900, id, id * 1000000) as id").unionByName(spark.createDataFrame([(None,)], "id long"))
    assert sum(numbers.where(condition).count() for condition in relational.range_predicates("id", bounds)) == 1001
    assert relational.range_predicates("id", []) == ["1 = 1"] and relational.balanced_bounds(keys.where("false"), "id", 8) == []
