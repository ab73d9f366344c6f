"""From raw person, visit and code tables to one row per subject.

All three sides are reduced to one row per subject before they are joined, each
with a partial aggregate in front of its shuffle. The joins then meet one row per
key on either side, already partitioned by that key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.bands import AGE_BANDS, band, whole_number
from cohortry.operators.codes import binary, category_counts, category_flags, with_summary
from cohortry.operators.joins import renamed_keys, with_text_key
from cohortry.operators.membership import CategoryMap, keep_members, mapped_values, relabel
from cohortry.operators.ordered import least
from cohortry.sources.codelists import CodeList


@dataclass(frozen=True)
class Study:
    """What a cohort is built from, and the names of its columns.

    ``keys`` name a subject in ``persons``; ``visit_keys`` and ``diagnosis_keys``
    are the matching columns of the other tables when they are named differently.
    Category maps given as tables are read once, here.
    """

    persons: DataFrame
    visits: DataFrame
    diagnoses: DataFrame
    races: CategoryMap
    sexes: CategoryMap
    settings: CategoryMap
    codes: CodeList
    keys: Sequence[str] = ("patientid",)
    visit_keys: Sequence[str] | None = None
    diagnosis_keys: Sequence[str] | None = None
    visit_order: Sequence[str] = field(default=("visit_id",))
    substances: str = "sud"
    disorders: str = "dx"

    def __post_init__(self) -> None:
        for name in ("races", "sexes", "settings"):
            object.__setattr__(self, name, mapped_values(getattr(self, name)))

    @property
    def substance_names(self) -> list[str]:
        return list(self.codes.categories[self.substances])

    @property
    def disorder_names(self) -> list[str]:
        return list(self.codes.categories[self.disorders])

    @property
    def flag_names(self) -> list[str]:
        return self.disorder_names + self.substance_names


def _listed(**categories: CategoryMap) -> dict[str, list[str]]:
    """The values of the maps that are held as values."""
    return {column: list(pairs) for column, pairs in categories.items() if isinstance(pairs, dict)}


def eligible_persons(study: Study) -> DataFrame:
    """Persons of a wanted race and sex, one row per subject."""
    kept = keep_members(study.persons, "race", study.races).where(F.col("race").isNotNull())
    kept = with_text_key(keep_members(kept, "sex", study.sexes), *study.keys, "sex")
    return least(kept, study.keys, ["race", "sex"], ["race", "sex"], _listed(race=study.races, sex=study.sexes))


def first_visits(study: Study) -> DataFrame:
    """Each subject's youngest visit in a wanted setting; ages that are no integer are ignored.

    Visits at one age are told apart by ``visit_order``.
    """
    visits = keep_members(study.visits, "visit_type", study.settings)
    visits = renamed_keys(visits, study.visit_keys or study.keys, study.keys)
    visits = with_text_key(visits, *study.keys).withColumn("age", whole_number(F.col("age").cast("string")))
    visits = visits.where(F.col("age").isNotNull())
    order = ["age", *study.visit_order, "visit_type"]
    return least(visits, study.keys, order, ["age", "visit_type"], _listed(visit_type=study.settings))


def subjects(study: Study) -> DataFrame:
    """Eligible persons with their first visit."""
    return eligible_persons(study).join(first_visits(study), list(study.keys))


def diagnoses(study: Study) -> DataFrame:
    """Code rows with the subject's key names, keys as text."""
    return with_text_key(renamed_keys(study.diagnoses, study.diagnosis_keys or study.keys, study.keys), *study.keys)


def described(study: Study, table: DataFrame, bands=AGE_BANDS) -> DataFrame:
    """Subjects above age 0, with category labels and the age band."""
    table = table.where(F.col("age") > 0)
    for column, categories in (("race", study.races), ("visit_type", study.settings), ("sex", study.sexes)):
        table = relabel(table, column, categories)
    return table.withColumn("age_categorical", band(F.col("age"), bands))


def counted_cohort(study: Study, bands=AGE_BANDS) -> DataFrame:
    """The master table: subjects with the number of distinct codes per category."""
    counts = category_counts(diagnoses(study), study.codes, study.keys)
    return described(study, subjects(study).join(counts, list(study.keys)), bands)


def flagged(study: Study, counted: DataFrame) -> DataFrame:
    """The master table with 0/1 flags and their row-wise sums."""
    return with_summary(binary(counted, study.flag_names), study.substance_names, study.disorder_names)


def cohort(study: Study, listed_only: bool = False, bands=AGE_BANDS) -> DataFrame:
    """Subjects with 0/1 flags and their sums, without counting distinct codes on the way.

    ``listed_only`` leaves out subjects without any listed code; the reports count
    subjects with a listed disorder only. ``bands`` are the age bands.
    """
    flags = category_flags(diagnoses(study), study.codes, study.keys, listed_only=listed_only)
    joined = described(study, subjects(study).join(flags, list(study.keys)), bands)
    return with_summary(joined, study.substance_names, study.disorder_names)


def in_scope(other_sex: str = "Others") -> Column:
    """Subjects the reports count: at least one disorder, and not of the left-out sex."""
    return (F.col("dx_count") > 0) & (F.col("sex") != other_sex)


def scoped(study: Study) -> DataFrame:
    return cohort(study, listed_only=True).where(in_scope())
