from __future__ import annotations

from dataclasses import replace

import pytest

from checks.study import study
from cohortry.operators import logit
from cohortry.plans import reports
from cohortry.plans.cohort import cohort, counted_cohort, flagged, scoped
from cohortry.plans.run import run_study


@pytest.fixture(scope="module")
def table(spark, folder):
    made = study(spark, folder)
    return reports.subject_cells(cohort(made), made.flag_names).cache()


def test_levels_without_subjects_have_a_row(table):
    found = reports.table1(table)
    assert found.where("level = 'Others' and n = 0 and p = 0").count() == found.select("stratum").distinct().count()
    assert reports.table1(table, keep_empty=False).where("n = 0").count() == 0


def test_table1_text(table):
    lines = {(r["stratum"], r["level"]): r for r in reports.table1_lines(table).collect()}
    facts = {(r["stratum"], r["level"]): r for r in reports.table1(table).collect()}
    for key, row in facts.items():
        text = lines[key]["line"]
        if key[0] == "ALL":
            assert text == f"{key[1]:<9}: {row['n']!s:<8} ({round(row['p'] * 100, 1)})"
        else:
            shown = [round(row[c] * 100, 1) for c in ("p", "lo", "hi")]
            assert text == f"{key[1]:<9}: {shown[0]!s:<8} ({shown[1]}-{shown[2]})"


def test_table2_total_may_leave_out_a_band(spark, folder, table):
    names = study(spark, folder).substance_names
    sizes = {}
    for left_out in ((), ("1-11",)):
        found = reports.table2(table, names, total_left_out=left_out).where("age = 'Total' and measure = 'sample_size'")
        sizes[left_out] = sum(row["value"] for row in found.collect())
    assert sizes[("1-11",)] < sizes[()]
    assert reports.table2(table, names).where("age = '1-11'").count() == 0


def test_figure_has_fixed_order(spark, folder, table):
    found = reports.figure1(table, study(spark, folder).disorder_names)
    assert {(row["race"], row["ord"]) for row in found.collect()} == {("AA", 1), ("NHPI", 2), ("MR", 3)}
    assert reports.figure1(table, study(spark, folder).disorder_names, least=101).count() == 0


def test_whole_study(spark, folder, tmp_path, table):
    made = study(spark, folder)
    first = run_study(made, str(tmp_path))
    assert sorted(first) == ["cells", "cohort", "figure1", "metrics", "table1", "table2", "table2_text", "table2_wide", *(f"table{n}{kind}" for n in (3, 4) for kind in ("", "_text"))]
    assert first["cells"].exceptAll(table).isEmpty() and table.exceptAll(first["cells"]).isEmpty()
    assert all(not rows.isEmpty() for rows in first.values())
    written = {path: path.stat().st_mtime_ns for path in tmp_path.rglob("*.parquet")}
    again = run_study(made, str(tmp_path))
    assert written == {path: path.stat().st_mtime_ns for path in tmp_path.rglob("*.parquet")}
    assert again["table3"].count() == first["table3"].count()
    aa = replace(made, persons=made.persons.where("race = 'BUILDING'"))
    bands = [(0, 0, "0"), (1, 40, "young"), (41, None, "old")]
    other = run_study(aa, str(tmp_path), bands=bands)
    assert {r["race"] for r in other["cohort"].select("race").distinct().collect()} == {"AA"}
    assert {r["age_categorical"] for r in other["cohort"].select("age_categorical").distinct().collect()} == {"young", "old"}
    assert "Bipolar (I/II)" in {r["header"] for r in other["figure1"].collect()}


def test_counts_and_flags_give_one_cohort(spark, folder):
    """Flags taken directly equal the flags made from the counts of distinct codes."""
    made = study(spark, folder)
    direct = cohort(made)
    counted = flagged(made, counted_cohort(made)).select(direct.columns)
    assert direct.exceptAll(counted).isEmpty() and counted.exceptAll(direct).isEmpty()


@pytest.mark.parametrize("keep_empty", [True, False])
def test_table1_divides_by_the_whole_stratum(spark, keep_empty):
    rows = [("AA", "18-34", "F", 90), ("AA", None, "F", 10)]
    cells = spark.createDataFrame(rows, "race string, age_categorical string, sex string, n long")
    assert {row["total"] for row in reports.table1(cells, keep_empty).collect()} == {100}


def test_table3_takes_its_parameters(spark, folder):
    subjects = scoped(study(spark, folder))
    _, terms, fits = reports.table3(
        subjects, covariates=("sex",), targets=("any_sud",), reference=("sex_M",), total_reference=("race_MR",)
    )
    assert {fit.target for fit in fits} == {"any_sud"}
    assert set(terms) == {"race_AA", "race_NHPI", "sex_F", "intercept"}
    lines = reports.odds_lines(logit.odds_ratios(spark, fits)).collect()
    assert any(line["heading"].startswith("Total (") for line in lines)


def test_odds_lines_of_infinite_and_missing_ratios(spark):
    schema = "stratum string, target string, term string, or_ double, lo double, hi double, n long"
    rows = [("ALL", "t", "a", float("inf"), 0.0, float("inf"), 7), ("AA", "t", "b", None, None, None, 2), ("AA", "t", "c", 1.234, 0.5, 10.0, 2)]
    found = [tuple(row) for row in reports.odds_lines(spark.createDataFrame(rows, schema)).collect()]
    assert found == [
        ("Total (7)", "t", "a", "inf", "0.00", "inf"),
        ("AA (2)", "t", "b", None, None, None),
        ("AA (2)", "t", "c", "1.23", "0.50", "10.00"),
    ]
