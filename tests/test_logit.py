from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression

from checks.study import study
from cohortry.operators.logit import Fit, by_outcome, fit_all, odds_ratios
from cohortry.operators.separation import limit
from cohortry.operators.odds import crude_odds_ratios
from cohortry.plans import reports
from cohortry.plans.cohort import scoped
from cohortry.session import stored


def fit_of(spark, rows, terms, outcome="y"):
    """Fits ``rows`` of (terms..., y) as stratum ``s``."""
    from pyspark.sql import functions as F

    names = [*terms, outcome]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    table = df.groupBy(*terms).agg(F.count("*").alias("n"), F.sum(outcome).alias(outcome))
    table = table.select(F.lit("s").alias("stratum"), F.lit(1).alias("intercept"), *terms, "n", outcome)
    used = [*terms, "intercept"]
    (fit,) = fit_all(stored(by_outcome(table, used, [outcome])), used, [Fit("s", outcome, used)])
    return fit


def random_rows(seed, n, terms):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [int(rng.random() < 0.4) for _ in range(terms)]
        p = 1 / (1 + math.exp(0.5 - 0.8 * x[0] + 0.6 * sum(x[1:])))
        rows.append((*x, int(rng.random() < p)))
    return rows


def test_agrees_with_glm(spark):
    terms = ["x_one", "x_two", "x_three"]
    rows = random_rows(1, 1500, 3)
    fit = fit_of(spark, rows, terms)
    df = VectorAssembler(inputCols=terms, outputCol="features").transform(
        spark.createDataFrame(rows, "x_one int, x_two int, x_three int, y int")
    )
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", tol=1e-12, maxIter=50).fit(df)
    assert fit.status == "ok" and fit.n == 1500
    assert np.allclose(fit.beta, [*glm.coefficients, glm.intercept], atol=1e-8)
    assert np.allclose(fit.error, glm.summary.coefficientStandardErrors, atol=1e-6)


def test_one_factor_has_closed_form(spark):
    rows = [(1, 1)] * 30 + [(1, 0)] * 70 + [(0, 1)] * 10 + [(0, 0)] * 90
    fit = fit_of(spark, rows, ["x"])
    assert math.exp(fit.beta[0]) == pytest.approx(27 / 7, abs=1e-9)
    assert fit.error[0] == pytest.approx(math.sqrt(1 / 30 + 1 / 70 + 1 / 10 + 1 / 90), abs=1e-9)
    df = spark.createDataFrame([("s", *row) for row in rows], "race string, x int, y int")
    crude = crude_odds_ratios(df, ["x"], "y").first()
    shown = {row["term"]: row for row in odds_ratios(spark, [fit]).collect()}["x"]
    for name in ("or_", "lo", "hi"):
        assert crude[name] == pytest.approx(shown[name], abs=1e-8)


def test_constant_column_is_singular(spark):
    assert fit_of(spark, [(1, 1)] * 5 + [(1, 0)] * 5, ["x"]).status == "singular"


def test_flag_equal_to_outcome_is_separated(spark):
    fit = fit_of(spark, [(1, 1)] * 5 + [(0, 0)] * 5, ["x"])
    assert fit.status == "separated"


def test_same_outcome_for_all_is_separated(spark):
    fit = fit_of(spark, [(1, 1)] * 5 + [(0, 1)] * 5, ["x"])
    assert fit.status == "separated"


def test_pinned_term_leaves_the_rest_right(spark):
    """A flag without events: the other terms equal the fit without its subjects."""
    rows = [(0, *row) for row in random_rows(2, 400, 2)] + [(1, i % 2, i % 3 % 2, 0) for i in range(20)]
    fit = fit_of(spark, rows, ["never", "x_one", "x_two"])
    rest = fit_of(spark, [row[1:] for row in rows if not row[0]], ["x_one", "x_two"])
    assert (fit.status, rest.status) == ("separated", "ok")
    assert np.allclose(fit.beta[1:], rest.beta, atol=1e-9)
    assert np.allclose(fit.error[1:], rest.error, atol=1e-9)
    shown = {row["term"]: row for row in odds_ratios(spark, [fit]).collect()}["never"]
    assert (shown["or_"], shown["lo"], shown["hi"]) == (0.0, 0.0, math.inf)


def test_empty_stratum(spark):
    df = spark.createDataFrame([("s", 1, 4, 2)], "stratum string, intercept int, n int, y int")
    table = stored(by_outcome(df, ["intercept"], ["y"]))
    fits = fit_all(table, ["intercept"], [Fit("s", "y", ["intercept"]), Fit("absent", "y", ["intercept"]), Fit("s", "y", [])])
    assert [fit.status for fit in fits] == ["ok", "empty", "empty"]
    assert odds_ratios(spark, fits).count() == 3


@pytest.mark.parametrize("number", [3, 4])
def test_reports_solve_the_score_equations(spark, folder, number):
    made = study(spark, folder)
    subjects = scoped(made)
    rows, terms, fits = reports.table3(subjects) if number == 3 else reports.table4(subjects, made.disorder_names)
    found = rows.collect()
    for fit in fits:
        if fit.status == "ok":
            mine = [row for row in found if (row["stratum"], row["target"]) == (fit.stratum, fit.target)]
            x = np.array([[row[f"x{terms.index(term)}"] for term in fit.terms] for row in mine], dtype=float)
            y, n = (np.array([row[c] for row in mine], dtype=float) for c in ("y", "n"))
            assert fit.n == n.sum()
            assert np.abs(x.T @ (y - n / (1 + np.exp(-x @ fit.beta)))).max() < 1e-7
    assert any(fit.status == "ok" for fit in fits)


def test_table4_can_leave_out_a_band(spark, folder):
    made = study(spark, folder)
    subjects = scoped(made)
    whole = reports.table4(subjects, made.disorder_names, more_than=3)[2]
    older = reports.table4(subjects, made.disorder_names, more_than=3, left_out=[("age_categorical", "1-11")])[2]
    assert sum(fit.n for fit in older) < sum(fit.n for fit in whole)
    assert all("substance_use" not in fit.terms for fit in whole)


def test_limits_are_those_of_all_small_directions():
    """Decided patterns and infinite terms against every direction of small whole numbers."""
    rng = np.random.default_rng(0)
    for _ in range(500):
        size = int(rng.integers(1, 5))
        x = np.array(list(itertools.product([0, 1], repeat=size - 1))).reshape(2 ** (size - 1), -1)
        x = np.c_[x, np.ones(len(x))][rng.random(len(x)) < 0.8]
        sign = rng.choice([-1.0, 0.0, 1.0], len(x), p=[0.4, 0.2, 0.4])
        found = limit(x[sign == 0], x[sign != 0], sign[sign != 0])
        directions = np.array(list(itertools.product(range(-3, 4), repeat=size)))
        moves = directions @ x.T
        cone = directions[((moves * sign >= 0) & ((sign != 0) | (moves == 0))).all(axis=1)]
        decided = ((cone @ x.T) * sign > 0).any(axis=0)
        assert (((x @ found.direction) * sign > 0.5) == decided).all() and found.decided == decided.any()
        assert np.abs((x @ found.direction)[~decided]).max(initial=0) < 1e-8
        assert len(found.free) == (np.linalg.matrix_rank(x[~decided]) if (~decided).any() else 0)
        for j in range(size):
            up, down = (cone[:, j] > 0).any(), (cone[:, j] < 0).any()
            want = np.nan if up and down else int(up) - int(down)
            assert np.array_equal(found.infinite[j], want, equal_nan=True)


def test_terms_that_run_off_together(spark):
    """Subjects with either of two terms all have the outcome: which term grows is open, the others' estimates are not."""
    rows = [(1, 1, x, 1) for x in (0, 1)] * 5 + [(0, 0, x, y) for x, y in ((0, 0), (0, 1), (1, 0), (1, 1), (1, 1))] * 4
    shown = {row["term"]: row for row in odds_ratios(spark, [fit_of(spark, rows, ["a", "b", "x"])]).collect()}
    assert shown["a"]["status"] == "separated" and shown["a"]["beta"] is None and shown["b"]["or_"] is None
    assert shown["x"]["beta"] == pytest.approx(math.log(2)) and shown["intercept"]["beta"] == pytest.approx(0, abs=1e-9)


def test_separation_in_sequence(spark):
    """x1 decides its subjects first; x2 is then decided among the rest and must not undo that."""
    cases = [((1, 1), 50, 50), ((1, 0), 50, 50), ((0, 1), 50, 0), ((0, 0), 100, 40)]
    rows = [(*x, int(i < y)) for x, n, y in cases for i in range(n)]
    fit = fit_of(spark, rows, ["x1", "x2"])
    assert fit.status == "separated"
    assert fit.beta[2] == pytest.approx(math.log(40 / 60))
    shown = {row["term"]: row["beta"] for row in odds_ratios(spark, [fit]).collect()}
    assert shown["x1"] == math.inf and shown["x2"] == -math.inf
