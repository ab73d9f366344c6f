"""The whole study: every table written once under one folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame

from cohortry.functions.bands import AGE_BANDS
from cohortry.operators.counts import complete, metrics
from cohortry.operators.logit import odds_ratios
from cohortry.plans import reports
from cohortry.plans.cohort import Study, cohort
from cohortry.sources.codelists import CodeList
from cohortry.sources.stages import identity, materialise


def fingerprint(study: Study) -> str:
    """A digest of what a study is made from: its tables with their filters, files and rows, its maps, code list and keys."""
    parts: list[str] = []
    for field in fields(study):
        value = getattr(study, field.name)
        if isinstance(value, CodeList):
            parts.append(repr((field.name, value.categories, value.known)))
            value = value.codes
        if isinstance(value, DataFrame):
            parts.append(repr((field.name, identity(value))))
        elif not isinstance(value, CodeList):
            parts.append(repr((field.name, value)))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def run_study(
    study: Study,
    folder: str,
    table3: Mapping[str, Any] | None = None,
    table4: Mapping[str, Any] | None = None,
    level: float = 0.95,
    bands: Sequence[tuple[int, int | None, str]] = AGE_BANDS,
) -> dict[str, DataFrame]:
    """The stored cohort, cells and reports by name.

    ``table3`` and ``table4`` are further arguments of those reports, ``level`` that of their intervals, ``bands`` the age bands.

    The raw tables are read once, for the cohort; the reports start from the stored
    cohort or its cells. A run that was stopped goes on after its last complete table;
    tables of another study in the same folder are built anew.
    """
    spark = study.persons.sparkSession
    mark = f"{fingerprint(study)} {tuple(bands)}"
    first, second = dict(table3 or {}), dict(table4 or {})
    asked = f"{mark} {level} {sorted(first.items())} {sorted(second.items())}"
    made: dict[str, DataFrame] = {}

    def keep(name: str, build: Callable[[], DataFrame], under: str = mark) -> DataFrame:
        made[name] = materialise(spark, f"{folder}/{name}", build, under)
        return made[name]

    subjects = keep("cohort", lambda: cohort(study, bands=bands))
    table = keep("cells", lambda: reports.subject_cells(subjects, study.flag_names))
    groups = {"substances": [*reports.TARGETS, *study.substance_names], "disorders": study.disorder_names}
    keep("metrics", lambda: complete(metrics(table, reports.DIMENSIONS, groups)))
    keep("table1", lambda: reports.table1(table))
    long = keep("table2", lambda: reports.table2(table, study.substance_names))
    shown = [label for _, _, label in bands if label not in ("0", *reports.TABLE2_LEFT_OUT)]
    keep("table2_text", lambda: reports.table2_lines(long, shown, study.substance_names))
    keep("table2_wide", lambda: reports.table2_wide(long, shown, study.substance_names))
    keep("figure1", lambda: reports.with_headers(reports.figure1(table, study.disorder_names), "diagnosis", study.codes.headers))
    odds = {
        "table3": lambda: odds_ratios(spark, reports.table3(subjects, **first)[2], level),
        "table4": lambda: odds_ratios(spark, reports.table4(subjects, study.disorder_names, **second)[2], level),
    }
    for name, build in odds.items():
        keep(name, build, asked)
        keep(f"{name}_text", lambda name=name: reports.odds_lines(made[name]), asked)
    return made
