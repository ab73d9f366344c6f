from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortry.functions.bands import band, whole_number
from cohortry.functions.names import clean_name, clean_text, clean_unique
from cohortry.functions.stats import log_odds_bounds, normal_quantile, one_decimal, proportion, two_by_two, wald_bounds, wald_margin

NAMES = [("Bipolar (I/II)", "bipolar_"), ("A/B-C, D", "a_b_c__d"), ("Plain", "plain"), ("x (y) z", "x__z")]


def test_names(spark):
    found = spark.createDataFrame(NAMES, "raw string, clean string").select(clean_name("raw").alias("got"), "clean")
    assert all(row["got"] == row["clean"] for row in found.collect())
    assert all(clean_text(raw) == clean for raw, clean in NAMES)


def test_name_collision():
    assert clean_unique(["A b", "C"]) == {"A b": "a_b", "C": "c"}
    with pytest.raises(ValueError):
        clean_unique(["A b", "a-b"])


def test_bands(spark):
    ages = [0, 1, 11, 12, 17, 18, 34, 35, 49, 50, 99, -1, None]
    found = spark.createDataFrame([(a,) for a in ages], "age int").select("age", band(F.col("age")).alias("band"))
    expected = ["0", "1-11", "1-11", "12-17", "12-17", "18-34", "18-34", "35-49", "35-49", "50+", "50+", None, None]
    assert {row["age"]: row["band"] for row in found.collect()} == dict(zip(ages, expected))


def test_whole_number(spark):
    found = spark.createDataFrame([("9",), ("10",), ("9.5",), ("x",), (None,)], "t string").select(
        whole_number(F.col("t")).alias("n")
    )
    assert [row["n"] for row in found.collect()] == [9, 10, None, None, None]


def test_wald(spark):
    cases = spark.createDataFrame([(0.5, 100), (0.0, 10), (0.5, 0)], "p double, n bigint")
    low, high = wald_bounds(F.col("p"), F.col("n"))
    half, none, empty = cases.select(low.alias("lo"), high.alias("hi"), wald_margin(F.col("p"), F.col("n")).alias("m")).collect()
    assert (round(half["lo"], 6), round(half["hi"], 6)) == (0.402002, 0.597998)
    assert half["m"] < 0
    assert none["lo"] == none["hi"] == 0
    assert empty["lo"] is None and empty["hi"] is None
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)


def test_proportion_of_nothing(spark):
    assert spark.range(1).select(proportion(F.lit(0), F.lit(0)).alias("p")).first()["p"] is None


def test_odds(spark):
    cells = spark.createDataFrame([(30, 70, 10, 90), (0, 70, 10, 90)], "a int, b int, c int, d int")
    log_odds, error = two_by_two(*(F.col(c) for c in "abcd"))
    ratio, low, high = log_odds_bounds(log_odds, error)
    full, empty = cells.select(ratio.alias("r"), low.alias("lo"), high.alias("hi")).collect()
    se = math.sqrt(1 / 30 + 1 / 70 + 1 / 10 + 1 / 90)
    assert full["r"] == pytest.approx(27 / 7)
    assert full["lo"] == pytest.approx(math.exp(math.log(27 / 7) - 1.959963984540054 * se))
    assert full["hi"] == pytest.approx(math.exp(math.log(27 / 7) + 1.959963984540054 * se))
    assert empty["r"] is None


def test_one_decimal(spark):
    rng = random.Random(5)
    values = [0.0, 0.25, 0.35, 21.95, 12.0, 99.95, 100.0, 3.46, 0.05, 0.15]
    values += [rng.randrange(0, 20000) / 200 for _ in range(2000)] + [rng.random() * 100 for _ in range(2000)]
    values += [rng.randrange(0, 500) / rng.randrange(500, 900) * 100 for _ in range(2000)]
    shown = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal(F.col("v")).alias("t"))
    assert all(row["t"] == f"{row['v']:1.1f}" == str(round(row["v"], 1)) for row in shown.collect())
