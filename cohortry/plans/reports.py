"""Tables 1 to 4 and the data of figure 1.

``table`` arguments are cells (``subject_cells``) or pattern tables: the reports
do not read the subjects again. ``subjects`` are rows of the cohort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.stats import one_decimal, percent, proportion, wald_bounds
from cohortry.operators.counts import ALL, cells, complete, drop_small_everywhere, level_counts, with_total
from cohortry.operators.design import dummies, dummy_names, level_support, patterns, support
from cohortry.operators.logit import INTERCEPT, Fit, by_outcome, fit_all
from cohortry.operators.membership import exclude
from cohortry.plans.cohort import in_scope
from cohortry.session import local_frame, stored

DIMENSIONS = ("age_categorical", "sex")

# Fixed values of the reports.
TARGETS = ("any_sud", "ge2_sud")
TABLE2_LEFT_OUT = ("1-11",)
FIGURE_LEAST_PERCENT = 3.0
FIGURE_ORDER = ("AA", "NHPI", "MR")
TABLE3_COVARIATES = ("age_categorical", "sex", "visit_type")
TABLE3_LEFT_OUT = (("sex", "Others"), ("age_categorical", "1-11"))
TABLE3_REFERENCE = ("visit_type_Mental health center", "sex_F", "age_categorical_50+")
TABLE3_TOTAL_REFERENCE = ("race_AA",)
TABLE4_MORE_THAN = 30
TABLE4_DROPPED = ("substance_use",)


def subject_cells(subjects: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Cells of every subject, counting those in scope (levels seen only outside stay, with zero)."""
    return cells(subjects, ("race", *DIMENSIONS), [*TARGETS, *flags], in_scope())


def _sized(counts: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``total``, the size of the whole stratum, subjects without a level included."""
    sizes = with_total(table, "race", [], ["n"]).withColumnRenamed("n", "total")
    return counts.join(sizes, "stratum")


def table1(table: DataFrame, keep_empty: bool = True) -> DataFrame:
    """``stratum, dimension, level, n, total, p, lo, hi``: sizes, proportions, 95 % intervals."""
    counts = level_counts(table, DIMENSIONS)
    listed = complete(counts) if keep_empty else counts.where((F.col("n") > 0) & F.col("level").isNotNull())
    sized = _sized(listed, table)
    p = proportion(F.col("n"), F.col("total"))
    low, high = wald_bounds(F.col("p"), F.col("total"))
    return sized.withColumn("p", p).withColumns({"lo": low, "hi": high})


def table1_total(table: DataFrame, keep_empty: bool = True) -> DataFrame:
    """All subjects: number and percent per level."""
    whole = table1(table, keep_empty).where(F.col("stratum") == ALL)
    return whole.select("dimension", "level", "n", "total", (F.col("p") * 100).alias("pct"))


def table1_strata(table: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Each stratum: percent and its interval per level."""
    strata = table1(table, keep_empty).where(F.col("stratum") != ALL)
    in_percent = [(F.col(c) * 100).alias(name) for c, name in (("p", "pct"), ("lo", "lo"), ("hi", "hi"))]
    return strata.select("stratum", "dimension", "level", "total", *in_percent)


def table1_lines(table: DataFrame) -> DataFrame:
    """Table 1 as fixed-width text: ``level: n (pct)`` for all, ``level: pct (lo-hi)`` per stratum."""

    def shown(value: str) -> Column:
        return one_decimal(F.col(value) * 100)

    whole = F.format_string("%-9s: %-8s (%s)", "level", F.col("n").cast("string"), shown("p"))
    stratum = F.format_string("%-9s: %-8s (%s-%s)", "level", shown("p"), shown("lo"), shown("hi"))
    line = F.when(F.col("stratum") == ALL, whole).otherwise(stratum)
    return table1(table).select("stratum", "dimension", "level", line.alias("line"))


def table2(
    table: DataFrame,
    substances: Sequence[str],
    left_out: Sequence[str] = TABLE2_LEFT_OUT,
    total_left_out: Sequence[str] = (),
) -> DataFrame:
    """``race, age, measure, n, value``: sample size, and percent with each substance flag.

    ``left_out`` bands have no column of their own but count in ``Total``, unless
    they are also in ``total_left_out``.
    """
    flags = [*TARGETS, *substances]
    counted = table.where(~F.col("age_categorical").isin(list(total_left_out))) if total_left_out else table
    sums = (
        counted.groupingSets([[F.col("race"), F.col("age_categorical")], [F.col("race")]], "race", "age_categorical")
        .agg(
            F.grouping("age_categorical").alias("whole"),
            F.sum("n").alias("size"),
            *(F.sum(flag).alias(f"with_{flag}") for flag in flags),
        )
        .where((F.col("whole") == 1) | ~F.col("age_categorical").isin(list(left_out)))
    )
    size = F.struct(F.lit("sample_size").alias("measure"), F.col("size").cast("double").alias("value"))
    shares = [
        F.struct(F.lit(flag).alias("measure"), percent(F.col(f"with_{flag}"), F.col("size")).alias("value"))
        for flag in flags
    ]
    age = F.when(F.col("whole") == 1, F.lit("Total")).otherwise(F.col("age_categorical"))
    return sums.select("race", age.alias("age"), F.col("size").alias("n"), F.inline(F.array(size, *shares)))


def table2_wide(long: DataFrame, bands: Sequence[str], substances: Sequence[str]) -> DataFrame:
    """One row per race and measure, one column per band, ``Total`` first; ``ord`` puts the sample size first."""
    measures = ["sample_size", *TARGETS, *substances]
    order = F.array_position(F.array(*map(F.lit, measures)), F.col("measure")).cast("int")
    return (
        long.withColumn("ord", order)
        .groupBy("race", "ord", "measure")
        .pivot("age", ["Total", *bands])
        .agg(F.first("value"))
    )


def table2_lines(long: DataFrame, bands: Sequence[str], substances: Sequence[str]) -> DataFrame:
    """Table 2 as text: ``table2_wide`` with whole sample sizes and one-decimal percentages."""
    shown = F.when(F.col("value").isNotNull(), one_decimal(F.col("value")))
    cell = F.when(F.col("measure") == "sample_size", F.col("n").cast("string")).otherwise(shown)
    return table2_wide(long.withColumn("value", cell), bands, substances)


def odds_lines(odds: DataFrame) -> DataFrame:
    """Tables 3 and 4 as text: ``heading, target, term, odds, lo, hi``.

    The heading is the stratum with its size, ``Total`` for all; ratios have two
    digits, and ``inf`` for infinity. A fit without estimates has NULL cells.
    """

    def cell(name: str) -> Column:
        ratio = F.col(name)
        text = F.when(ratio == float("inf"), F.lit("inf")).otherwise(F.format_string("%.2f", ratio))
        return F.when(ratio.isNotNull(), text)

    stratum = F.when(F.col("stratum") == ALL, F.lit("Total")).otherwise(F.col("stratum"))
    heading = F.format_string("%s (%d)", stratum, "n")
    return odds.select(
        heading.alias("heading"), "target", "term", *(cell(c).alias(n) for c, n in (("or_", "odds"), ("lo", "lo"), ("hi", "hi")))
    )


def figure1(table: DataFrame, disorders: Sequence[str], least: float = FIGURE_LEAST_PERCENT) -> DataFrame:
    """``race, diagnosis, pct, ord, label``: a bar per race and disorder.

    A disorder below ``least`` percent in every race has no bars.
    """
    sums = table.groupBy("race").agg(F.sum("n").alias("n"), *(F.sum(d).alias(d) for d in disorders))
    bars = sums.unpivot(["race", "n"], list(disorders), "diagnosis", "flagged").select(
        "race", "diagnosis", percent(F.col("flagged"), F.col("n")).alias("pct")
    )
    order = F.array_position(F.array(*map(F.lit, FIGURE_ORDER)), F.col("race")).cast("int")
    kept = drop_small_everywhere(bars, "diagnosis", "pct", least)
    return kept.withColumns({"ord": order, "label": one_decimal(F.col("pct"))})


def with_headers(report: DataFrame, column: str, headers: Mapping[str, str]) -> DataFrame:
    """A report with ``header``: the name in ``column`` as the code list had it, the name itself where it had none."""
    columns = {"_name": list(headers), "_header": list(headers.values())}
    named = local_frame(report.sparkSession, columns, dict.fromkeys(columns, pa.string()))
    met = report.join(named, report[column] == named["_name"], "left")
    return met.select(*report.columns, F.coalesce("_header", column).alias("header"))


def table3_patterns(
    subjects: DataFrame,
    left_out: Sequence[tuple[str, str]] = TABLE3_LEFT_OUT,
    covariates: Sequence[str] = TABLE3_COVARIATES,
    targets: Sequence[str] = TARGETS,
) -> DataFrame:
    """Patterns of the covariates, with the events of the targets."""
    return patterns(exclude(subjects.where(in_scope()), left_out), ("race", *covariates), targets)


def table3_design(
    table: DataFrame,
    reference: Sequence[str] = TABLE3_REFERENCE,
    covariates: Sequence[str] = TABLE3_COVARIATES,
    targets: Sequence[str] = TARGETS,
    total_reference: Sequence[str] = TABLE3_TOTAL_REFERENCE,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Dummy-coded patterns for all subjects (``ALL``) and each race, and the terms of each.

    Race terms belong to ``ALL`` only, without the reference race. A level
    that a stratum lacks is no term there.
    """
    dropped = [*reference, *total_reference]
    found = level_support(table, "race", covariates)
    levels = {"race": sorted(found)}
    for variable in covariates:
        levels[variable] = sorted({level for pairs in found.values() for v, level in pairs if v == variable})
    order = dummy_names(levels, dropped)
    races = dummy_names({"race": levels["race"]}, dropped)
    used = {ALL: [*order, INTERCEPT]}
    for race, pairs in found.items():
        mine = {f"{variable}_{level}" for variable, level in pairs}
        used[race] = [name for name in order if name in mine and name not in races] + [INTERCEPT]
    copies = table.withColumn("stratum", F.explode(F.array(F.lit(ALL), F.col("race"))))
    return dummies(copies, levels, ("stratum", "n", *targets), dropped), used


def adjusted(
    design: DataFrame, used: dict[str, list[str]], targets: Sequence[str]
) -> tuple[DataFrame, list[str], list[Fit]]:
    """Fits of every stratum and target; returns the stored rows and terms they were fitted on."""
    terms = list(dict.fromkeys(term for names in used.values() for term in names))
    rows = stored(by_outcome(design, terms, targets))
    fits = [Fit(stratum, target, list(names)) for stratum, names in sorted(used.items()) for target in targets]
    return rows, terms, fit_all(rows, terms, fits)


def table3(
    subjects: DataFrame,
    covariates: Sequence[str] = TABLE3_COVARIATES,
    targets: Sequence[str] = TARGETS,
    left_out: Sequence[tuple[str, str]] = TABLE3_LEFT_OUT,
    reference: Sequence[str] = TABLE3_REFERENCE,
    total_reference: Sequence[str] = TABLE3_TOTAL_REFERENCE,
) -> tuple[DataFrame, list[str], list[Fit]]:
    """Adjusted odds ratios of the ``targets`` by the ``covariates`` (and race, over all strata).

    ``left_out`` pairs of column and value take no part; ``reference`` and
    ``total_reference`` name the dummies (``column_level``) that are no terms.
    """
    table = stored(table3_patterns(subjects, left_out, covariates, targets))
    design, used = table3_design(table, reference, covariates, targets, total_reference)
    return adjusted(design, used, targets)


def table4_patterns(
    subjects: DataFrame, disorders: Sequence[str], dropped: Sequence[str] = TABLE4_DROPPED
) -> DataFrame:
    """Patterns of the disorder flags per race (``stratum``)."""
    kept = [name for name in disorders if name not in dropped]
    return patterns(subjects.where(in_scope()), ("race", *kept), ("any_sud",)).withColumnRenamed("race", "stratum")


def table4(
    subjects: DataFrame,
    disorders: Sequence[str],
    more_than: int = TABLE4_MORE_THAN,
    left_out: Sequence[tuple[str, str]] = (),
    dropped: Sequence[str] = TABLE4_DROPPED,
) -> tuple[DataFrame, list[str], list[Fit]]:
    """Adjusted odds ratios of any substance flag by the other disorders but ``dropped`` ones, per race.

    A disorder recorded for ``more_than`` subjects of a race or fewer is no term there.
    """
    table = stored(table4_patterns(exclude(subjects, left_out), disorders, dropped))
    kept = [name for name in disorders if name in table.columns]
    used: dict[str, list[str]] = {}
    for row in support(table, kept, "stratum").collect():
        used.setdefault(row["stratum"], [])
        if row["support"] > more_than:
            used[row["stratum"]].append(row["term"])
    used = {stratum: [d for d in kept if d in terms] + [INTERCEPT] for stratum, terms in used.items()}
    return adjusted(table.withColumn(INTERCEPT, F.lit(1)), used, ("any_sud",))
