"""Shapes of the physical plans that matter on large tables."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from checks.study import diagnosed, study, visits
from cohortry.operators import codes, membership
from cohortry.plans import cohort, reports

# Run jobs while they are built, so their plan shows only the last part.
EAGER = {name for name in entry_points.queries() if name.startswith(("table3", "table4", "lineage", "dummy"))}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Tables count as too large to broadcast, as they are on a cluster."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cohort_shuffles_each_side_once(spark, folder, no_broadcast):
    plan = plan_of(cohort.cohort(study(spark, folder)))
    assert len(re.findall(r"Exchange hashpartitioning\(patientid", plan)) == 3
    assert plan.count("SortMergeJoin [patientid") == 2
    assert plan.count("partial_min") == 2 and plan.count("partial_bit_or") == 1
    # The code list has a checked size and is the only broadcast side.
    assert len(re.findall(r"\+- BroadcastExchange", plan)) == 1


def test_report_adds_small_shuffles_only(spark, folder, no_broadcast):
    made = study(spark, folder)
    plan = plan_of(reports.table1(reports.subject_cells(cohort.cohort(made), made.flag_names)))
    assert len(re.findall(r"Exchange hashpartitioning\(patientid", plan)) == 3
    assert "partial_sum" in plan and "partial_count" in plan


def test_codes_are_combined_before_the_shuffle(spark, folder, no_broadcast):
    made = study(spark, folder)
    plan = plan_of(codes.category_counts(cohort.diagnoses(made), made.codes, made.keys))
    assert plan.index("Exchange hashpartitioning(patientid") < plan.index("partial_bit_or")
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_persons_are_hashed_before_the_shuffle(spark, folder, no_broadcast):
    plan = plan_of(cohort.eligible_persons(study(spark, folder)))
    assert plan.index("Exchange hashpartitioning(patientid") < plan.index("partial_min")
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_visits_are_hashed_where_their_types_fit_a_number(spark, folder, no_broadcast):
    made = study(spark, folder)
    assert "SortAggregate" in plan_of(cohort.first_visits(made))  # any int age beside any bigint visit number
    short = replace(made, visits=made.visits.withColumn("visit_id", (F.col("visit_id") % 100).cast("smallint")))
    plan = plan_of(cohort.first_visits(short))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_map_filter_reaches_the_scan(spark, folder):
    plan = cohort.first_visits(study(spark, folder))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderpriority" in text
    persons = membership.keep_members(spark.read.parquet(f"{folder}/customer.parquet"), "c_nationkey", {"3": "x", "4": "y"})
    assert "In(c_nationkey, [3,4])" in plan_of(persons)
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_totalprice" not in columns


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - EAGER))
def test_no_cross_join_and_no_python(spark, folder, no_broadcast, name):
    plan = plan_of(entry_points.queries()[name](spark, folder))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert unwanted not in plan


def test_nothing_depends_on_the_join_strategy(spark, folder, no_broadcast):
    """The flagship query over sort-merge joins gives the rows it gives over broadcast joins."""
    query = entry_points.queries()["cohort_summary"]
    merged = sorted(map(tuple, query(spark, folder).collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert merged == sorted(map(tuple, query(spark, folder).collect()))


def test_partitions_of_the_input_do_not_matter(spark, folder):
    made = study(spark, folder)
    whole = codes.category_counts(diagnosed(spark, folder), made.codes, made.keys)
    split = codes.category_counts(diagnosed(spark, folder).repartition(13), made.codes, made.keys)
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()
    assert visits(spark, folder).count() == visits(spark, folder).repartition(7).count()
