from __future__ import annotations

import random
from dataclasses import replace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from cohortry.operators import codes, counts, dedupe, design, joins, membership
from cohortry.operators.ordered import Packed, least
from cohortry.plans.cohort import Study, cohort, counted_cohort, eligible_persons, first_visits, flagged, subjects
from cohortry.sources.codelists import CodeList

LISTS = {"dx": {"Bipolar (I/II)": ["296.0", "303.90"], "Empty": []}, "sud": {"Alcohol": ["303.90", "305.0"]}}


def study_of(spark, persons, visits, diagnoses, lists=LISTS):
    return Study(
        spark.createDataFrame(persons, "patientid string, race string, sex int"),
        spark.createDataFrame(visits, "patientid string, age string, visit_type string, visit_id long"),
        spark.createDataFrame(diagnoses, "patientid string, dsmno string"),
        {"a": "AA", "m": "MR", "x": None},
        {"0": "F", "1": "M", "2": "Others"},
        {"in": "Inpatient", "out": "Outpatient", "no": None},
        CodeList.of(spark, lists),
    )


def large(spark, pairs):
    """A category map too large for an expression."""
    extra = [(f"unused{i}", "none") for i in range(membership.EXPRESSION_ROWS + 5)]
    return spark.createDataFrame([*pairs.items(), *extra], "value string, category string")


@pytest.mark.parametrize("size", ["dict", "frame", "large", "large dict"])
def test_membership_and_relabel(spark, size):
    pairs = {"X": "Y", "Y": "Z", "N": None}
    categories = {
        "dict": lambda: pairs,
        "frame": lambda: spark.createDataFrame(list(pairs.items()), "value string, category string"),
        "large": lambda: large(spark, pairs),
        "large dict": lambda: pairs | {f"unused{i}": "none" for i in range(membership.EXPRESSION_ROWS + 5)},
    }[size]()
    df = spark.createDataFrame([("X", 1), ("Y", 2), ("N", 3), ("other", 4), (None, 5)], "v string, id int")
    assert rows_of(membership.keep_members(df, "v", categories)) == [("X", 1), ("Y", 2)]
    found = {row["id"]: row["v"] for row in membership.relabel(df, "v", categories).collect()}
    assert found == {1: "Y", 2: "Z", 3: "N", 4: "other", 5: None}


def test_membership_compares_text(spark):
    df = spark.createDataFrame([(0,), (1,), (7,)], "sex int")
    assert rows_of(membership.keep_members(df, "sex", {"0": "F", "1": "M", "7": None})) == [(0,), (1,)]
    assert rows_of(membership.keep_members(df, "sex", {"1": "M", "07": "x", "7.0": "x", "a": "x"})) == [(1,)]
    assert rows_of(membership.relabel(df, "sex", {"0": "F"})) == [("1",), ("7",), ("F",)]


def test_exclude_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows_of(membership.exclude(df, [("v", "a")])) == [("b",), (None,)]


def test_dedupe(spark):
    df = spark.createDataFrame([("p", 9, 2), ("p", 9, 1), ("p", None, 0), ("q", None, 5), ("p", 10, 3)], "k string, v int, t int")
    assert rows_of(dedupe.keep_one(df, ["k"], "v", "lowest", ["t"])) == [("p", 9, 1), ("q", None, 5)]
    assert rows_of(dedupe.keep_one(df, ["k"], "v", "highest", ["t"])) == [("p", 10, 3), ("q", None, 5)]
    assert sorted(row["k"] for row in dedupe.keep_any(df, ["k"]).collect()) == ["p", "q"]
    with pytest.raises(ValueError):
        dedupe.keep_one(df, ["k"], "v", "middle")


@pytest.mark.parametrize("keep", ["lowest", "highest"])
def test_dedupe_hot_key(spark, keep):
    """A key with a third of all rows, spread over many partitions, against brute force."""
    rng = random.Random(11)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(50)}", rng.choice([None, *range(40)]), i) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, v int, t int").repartition(16)
    expected = {}
    for k, v, t in rows:
        rank = (v is None, v or 0, t) if keep == "lowest" else (v is None, -(v or 0), -t)
        if k not in expected or rank < expected[k][0]:
            expected[k] = (rank, (k, v, t))
    assert rows_of(dedupe.keep_one(df, ["k"], "v", keep, ["t"])) == sorted((row for _, row in expected.values()), key=repr)


def test_filtered_join(spark):
    left = spark.createDataFrame([(1, "hi"), (2, "no"), (3, "hi")], "id int, race string")
    right = spark.createDataFrame([(1, 9), (3, 2), (1, 6)], "identification int, age int")
    found = joins.filtered_join(left, right, [("id", "identification")], F.col("race") == "hi", F.col("age") > 5)
    assert found.columns == ["id", "race", "age"]
    assert rows_of(found) == [(1, "hi", 6), (1, "hi", 9)]


@pytest.mark.parametrize("kind", ["bigint", "tinyint"])
def test_least_combination_packed_and_as_struct(spark, kind):
    top = 2**63 - 1 if kind == "bigint" else 127
    draw = random.Random(kind)
    numbers = [None, 0, 1, -1, 9, 10, top, top - 1, -top - 1]
    rows = [(draw.randrange(60), draw.choice([None, -(2**31), 2**31 - 1, 0, 5]), draw.choice(numbers), draw.choice([None, "b", "a", "\u00e9", "B"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "id int, age int, visit bigint, place string").withColumn("visit", F.col("visit").cast(kind))
    columns, listed = ["age", "visit", "place"], {"place": ["b", "a", "\u00e9", "B"]}
    assert Packed.fits(df, columns, listed) == (kind == "tinyint")
    found = least(df, ["id"], columns, columns, listed)
    assert found.schema == least(df, ["id"], columns, columns, {}).schema
    best = {}
    for key, *rest in rows:
        best[key] = min(best.get(key, rest), rest, key=lambda r: [(x is not None, x.encode() if isinstance(x, str) else x or 0) for x in r])
    for table in (found, least(df, ["id"], columns, columns, {})):
        assert {r[0]: list(r[1:]) for r in table.collect()} == best
    assert least(df.where("false"), ["id"], columns, columns, {"place": []}).count() == 0


def test_first_visit(spark):
    made = study_of(
        spark,
        [("1", "a", 0), ("2", "m", 1), ("3", "x", 0), ("4", "a", 9), ("5", "a", 1), ("1", "a", 0), ("6", None, 0)],
        [
            ("1", "10", "in", 1), ("1", "9", "out", 2), ("1", "9", "in", 3), ("1", "5", "no", 4),
            ("2", None, "in", 5), ("2", "9.5", "in", 6), ("2", "40", "in", 7), ("3", "1", "in", 8), ("4", "1", "in", 9),
        ],
        [],
    )
    assert rows_of(first_visits(made)) == [("1", 9, "out"), ("2", 40, "in"), ("3", 1, "in"), ("4", 1, "in")]
    assert rows_of(eligible_persons(made)) == [("1", "a", "0"), ("2", "m", "1"), ("5", "a", "1")]
    assert rows_of(subjects(made)) == [("1", "a", "0", 9, "out"), ("2", "m", "1", 40, "in")]


def test_cohort(spark):
    made = study_of(
        spark,
        [("1", "a", 0), ("2", "m", 2), ("3", "a", 1), ("4", "a", 1)],
        [("1", "20", "in", 1), ("2", "55", "out", 2), ("3", "0", "in", 3), ("4", "12", "in", 4)],
        [("1", "303.90"), ("1", "303.90"), ("1", "296.0"), ("1", "305.0"), ("2", None), ("3", "296.0"), ("4", "999")],
    )
    table = cohort(made).select("patientid", "race", "sex", "visit_type", "age_categorical", "bipolar_", "empty", "alcohol", "sud_count", "dx_count", "any_sud", "ge2_sud")
    assert rows_of(table) == [
        ("1", "AA", "F", "Inpatient", "18-34", 1, 0, 1, 1, 1, 1, 0),
        ("2", "MR", "Others", "Outpatient", "50+", 0, 0, 0, 0, 0, 0, 0),
        ("4", "AA", "M", "Inpatient", "12-17", 0, 0, 0, 0, 0, 0, 0),
    ]
    assert [row["patientid"] for row in cohort(made, listed_only=True).collect()] == ["1"]
    counted = counted_cohort(made)
    assert {r["patientid"]: (r["bipolar_"], r["empty"], r["alcohol"]) for r in counted.collect()}["1"] == (2, 0, 2)
    assert rows_of(flagged(made, counted).select(table.columns)) == rows_of(table)


@pytest.mark.parametrize("size", ["small", "large"])
def test_study_from_map_tables(spark, folder, size):
    """Category maps read as tables, small and too large for an expression, give the same cohort."""
    from checks.study import RACES, SETTINGS, SEXES, study

    def table(pairs):
        return large(spark, pairs) if size == "large" else spark.createDataFrame(list(pairs.items()), "value string, category string")

    given = study(spark, folder)
    other = replace(given, races=table(RACES), sexes=table(SEXES), settings=table(SETTINGS), visit_order=("visit_id",))
    assert cohort(given).exceptAll(cohort(other)).isEmpty() and cohort(other).exceptAll(cohort(given)).isEmpty()
    assert isinstance(other.races, dict) == (size == "small")


def random_codes(spark, seed, names, per):
    """Code rows where one subject holds a third of them, and a list of ``names`` overlapping categories."""
    rng = random.Random(seed)
    every = [f"{i}.0" for i in range(names * per)]
    lists = {"dx": {f"C {i}": rng.sample(every, per) for i in range(names)}}
    rows = [("hot" if rng.random() < 0.33 else f"s{rng.randrange(40)}", rng.choice([*every, "unlisted", None])) for _ in range(6000)]
    return lists, rows


@pytest.mark.parametrize("names,per", [(5, 3), (70, 2), (20, 60)])
@pytest.mark.parametrize("known", [True, False])
def test_codes_against_brute_force(spark, names, per, known):
    """Up to and beyond one word of categories, and beyond the counted codes."""
    lists, rows = random_codes(spark, names, names, per)
    listed = CodeList.of(spark, lists)
    if not known:
        listed = CodeList(listed.categories, listed.codes)
    df = spark.createDataFrame(rows, "patientid string, dsmno string").repartition(6)
    seen: dict[str, set] = {}
    for patient, code in rows:
        seen.setdefault(patient, set()).add(code)
    expected = {p: [len(found & set(c)) for c in lists["dx"].values()] for p, found in seen.items()}
    counted = {r[0]: list(r[1:]) for r in codes.category_counts(df, listed, ["patientid"]).collect()}
    assert counted == expected
    flags = {r[0]: list(r[1:]) for r in codes.category_flags(df, listed, ["patientid"]).collect()}
    assert flags == {p: [int(n > 0) for n in row] for p, row in expected.items()}
    only = {r[0] for r in codes.category_flags(df, listed, ["patientid"], listed_only=True).collect()}
    assert only == {p for p, row in expected.items() if any(row)}


def test_distinct_codes_keep_null(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", None), ("1", None)], "patientid string, dsmno string")
    assert rows_of(codes.distinct_codes(df, ["patientid"])) == [("1", "a"), ("1", None)]


SUBJECTS = [("AA", "18-34", "F", 1), ("AA", "18-34", "M", 0), ("AA", "50+", "F", 1), ("MR", "50+", "F", 0), ("MR", "1-11", "Others", 1)]


def table_of(spark):
    df = spark.createDataFrame(SUBJECTS, "race string, age_categorical string, sex string, mood int")
    return counts.cells(df, ("race", "age_categorical", "sex"), ["mood"], F.col("sex") != "Others")


def test_counts(spark):
    table = table_of(spark)
    found = counts.level_counts(table, ["age_categorical"]).drop("dimension")
    assert rows_of(found) == [
        ("AA", "18-34", 2), ("AA", "50+", 1), ("ALL", "1-11", 0), ("ALL", "18-34", 2), ("ALL", "50+", 2), ("MR", "1-11", 0), ("MR", "50+", 1),
    ]
    assert rows_of(counts.flag_counts(table, ["mood"])) == [("AA", "mood", 2), ("ALL", "mood", 2), ("MR", "mood", 0)]
    assert ("AA", "age_categorical", "1-11", 0) in rows_of(counts.complete(counts.level_counts(table, ["age_categorical", "sex"])))
    everyone = counts.metrics(table, ["sex"], {"dx": ["mood"]}).where("dimension = 'everyone'").drop("dimension", "level")
    assert rows_of(everyone) == [("AA", 3), ("ALL", 4), ("MR", 1)]


def test_drop_small_everywhere(spark):
    df = spark.createDataFrame(
        [("a", "x", 2.9), ("b", "x", 2.9), ("c", "x", 3.0), ("a", "y", 2.9), ("b", "y", 2.9), ("c", "y", 2.9)],
        "race string, dx string, pct double",
    )
    assert {row["dx"] for row in counts.drop_small_everywhere(df, "dx", "pct", 3.0).collect()} == {"x"}


def test_design(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4), ("c.d", 5)], "v string, n int")
    found = design.level_support(df.withColumn("race", F.lit("r")), "race", ["v"])
    assert found == {"r": {("v", "a"): 3, ("v", "b"): 4, ("v", "c.d"): 5}}
    levels = {"v": ["a", "b", "c.d"]}
    table = design.dummies(df, levels, ["n"], drop=["v_a", "v_absent"])
    assert table.columns == ["n", "intercept", "v_b", "v_c.d"]
    assert rows_of(table) == [(3, 1, 0, 0), (4, 1, 1, 0), (5, 1, 0, 1)]
    found = design.support(table.withColumn("race", F.lit("r")), ["v_b", "v_c.d"])
    assert rows_of(design.supported(found, 4)) == [("r", "v_c.d", 5)]
    assert rows_of(design.supported(found, 3, drop=["v_c.d"])) == [("r", "v_b", 4)]


@pytest.mark.parametrize("size", [11, 301])
def test_map_columns_may_clash_with_the_table(spark, size):
    pairs = spark.createDataFrame([(str(i), f"c{i}") for i in range(size)], "value string, category string")
    df = spark.createDataFrame([(1, "a", "5"), (2, "b", "999")], "value int, _value string, category string")
    assert rows_of(membership.keep_members(df, "category", pairs)) == [(1, "a", "5")]
    assert rows_of(membership.relabel(df, "category", pairs)) == [(1, "a", "c5"), (2, "b", "999")]


def test_one_header_in_two_lists_is_an_error(spark):
    with pytest.raises(ValueError, match="Alcohol"):
        CodeList.of(spark, {"dx": {"Alcohol": ["303.00"]}, "sud": {"Alcohol": ["305.00"]}})


def test_complete_adds_zero_rows(spark):
    rows = [("a", "d", "x", 1), ("b", "d", "y", 2), ("a", "e", "z", 3), ("b", "d", None, 9)]
    df = spark.createDataFrame(rows, "stratum string, dimension string, level string, n long")
    found = [("a", "d", "x", 1), ("a", "d", "y", 0), ("a", "e", "z", 3), ("b", "d", "x", 0), ("b", "d", "y", 2)]
    assert rows_of(counts.complete(df)) == found


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("bits", [1, 5, 62])
def test_counts_of_many_codes(spark, known, bits):
    """More codes than a word holds, a code of two categories, an unlisted one, a subject without codes, repeats."""
    lists = {"dx": {"Low": [f"{i:03}" for i in range(0, 130)], "Even": [f"{i:03}" for i in range(0, 200, 2)]}, "sud": {"None": []}}
    listed = CodeList.of(spark, lists)
    if not known:
        listed = CodeList(listed.categories, listed.codes)
    rng = random.Random(5)
    rows = [(str(rng.randrange(6)), f"{rng.randrange(250):03}") for _ in range(600)] + [("none", None), ("other", "999"), ("0", "000"), ("0", "000")]
    want = {}
    for key, code in rows:
        want.setdefault(key, set()).add(code)
    low, even = set(lists["dx"]["Low"]), set(lists["dx"]["Even"])
    found = codes.category_counts(spark.createDataFrame(rows, "patientid string, dsmno string"), listed, ["patientid"], word_bits=bits)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {key: (len(got & low), len(got & even), 0) for key, got in want.items()}
