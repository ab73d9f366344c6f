"""Logistic regression over covariate patterns, all strata and outcomes in the same jobs.

Each step is one aggregate of the pattern table: its rows, however many, become
k rows of k + 2 sums per fit, which is all the driver sees. The Newton step is a
k by k solve there. Before the first step one more aggregate shows which likelihoods have
no maximum; those fits go to their limit, see ``separation``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.names import quoted
from cohortry.functions.stats import normal_quantile
from cohortry.operators.separation import Limit, limit
from cohortry.session import local_frame

# Fixed value: the most Newton steps.
MOST_STEPS = 35
STEP_TOLERANCE = 1e-10
# exp(-800) is 0 in double precision: subjects at this distance are predicted exactly.
FAR = 800.0
INTERCEPT = "intercept"


@dataclass
class Fit:
    """One regression: a stratum, an outcome and the terms allowed in it.

    ``n`` counts the subjects with the most frequent term: all of them when the
    terms include an intercept.
    """

    stratum: str
    target: str
    terms: list[str]
    n: int = 0
    status: str = "running"
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    error: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: What the fit tends to where its likelihood has no maximum; None where it has one.
    limit: Limit | None = None

    @property
    def infinite(self) -> np.ndarray:
        """Per term 0, or the sign of its infinite estimate, or not-a-number without any."""
        return self.limit.infinite if self.limit else np.zeros(len(self.terms))

    def start(self, limit: Limit | None) -> None:
        """Coefficients to begin with: those that already predict what the limit decides, and 0."""
        self.limit = limit
        self.beta = np.zeros(len(self.terms)) if limit is None else FAR * limit.direction
        self.error = np.full(len(self.terms), np.nan)
        self.status = "running" if self.terms else "empty"

    def advance(self, information: np.ndarray, score: np.ndarray) -> None:
        """One Newton step from the sums at the present coefficients.

        Decided patterns weigh nothing in the sums, so the steps are those of the fit of the others.
        """
        if self.limit is not None and not self.limit.decided:
            self.status = "singular"
            return
        free = np.arange(len(self.beta)) if self.limit is None else self.limit.free
        information, score = information[np.ix_(free, free)], score[free]
        if np.linalg.matrix_rank(_scaled(information), tol=1e-11) < len(free):
            self.status = "singular"
            return
        step = np.linalg.solve(information, score) if len(free) else np.zeros(0)
        self.beta[free] += step
        self.error[free] = np.sqrt(np.diag(np.linalg.inv(information))) if len(free) else 0
        if np.abs(step).max(initial=0) < STEP_TOLERANCE:
            self.status = "ok" if self.limit is None else "separated"


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Unit diagonal, so that the rank does not depend on the sizes of the columns."""
    scale = np.sqrt(np.clip(np.diag(matrix), 0, None))
    scale[scale == 0] = 1
    return matrix / np.outer(scale, scale)


def by_outcome(table: DataFrame, terms: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Pattern rows ``stratum, target, x0..., n, y``: one copy per outcome, terms by position."""
    ids = [quoted(term).alias(f"x{i}") for i, term in enumerate(terms)]
    named = table.select("stratum", *ids, "n", *outcomes)
    return named.unpivot(named.columns[: -len(outcomes)], list(outcomes), "target", "y")


def _with_fit(table: DataFrame, terms: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    """Pattern rows of the given fits with their probability ``p``.

    The coefficients come as a small joined table, not as literals, so the
    generated code is the same in every step and is compiled once.
    """
    columns: dict[str, list] = {"stratum": [f.stratum for f in fits], "target": [f.target for f in fits]}
    for i, term in enumerate(terms):
        columns[f"b{i}"] = [float(f.beta[f.terms.index(term)]) if term in f.terms else 0.0 for f in fits]
    types = {name: pa.string() if name in ("stratum", "target") else pa.float64() for name in columns}
    joined = table.join(local_frame(table.sparkSession, columns, types), ["stratum", "target"])
    eta = " + ".join(f"x{i} * b{i}" for i in range(len(terms)))
    return joined.selectExpr(*table.columns, f"1D / (1D + exp(-({eta}))) as p")


def _sums(table: DataFrame, terms: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    """Per fit and term: subjects, score, and the term's row of the information matrix.

    Pattern rows are taken apart by term, and only terms a pattern has go on.
    So a step costs what the ones in the design cost, and the aggregate has k + 2
    columns, few enough for generated code, rather than one per pair of terms.
    """
    x = [f"x{i}" for i in range(len(terms))]
    rows = _with_fit(table, terms, fits).selectExpr(
        "stratum", "target", *x, "n", "y - n * p as residual", "n * p * (1D - p) as weight"
    )
    apart = rows.unpivot(rows.columns, x, "term", "a").where("a <> 0")
    sums = ["sum(n) as n", "sum(a * residual) as score", *(f"sum(a * weight * {name}) as h{name}" for name in x)]
    return apart.groupBy("stratum", "target", "term").agg(*(F.expr(text) for text in sums))


def _limits(table: DataFrame, terms: Sequence[str], fits: Sequence[Fit]) -> dict[tuple[str, str], Limit]:
    """Limits of the fits that need one.

    One aggregate says what patterns of both outcomes span. Where that is everything, as on large data, the likelihood
    has a maximum. Only for other fits the patterns of one outcome come to the driver: distinct combinations of
    their terms, a number that the design bounds, not the subjects.
    """
    x = [f"x{i}" for i in range(len(terms))]
    columns: dict[str, list] = {"stratum": [f.stratum for f in fits], "target": [f.target for f in fits]}
    columns |= {f"m{i}": [int(term in f.terms) for f in fits] for i, term in enumerate(terms)}
    types = {name: pa.string() if name in ("stratum", "target") else pa.int32() for name in columns}
    wanted = local_frame(table.sparkSession, columns, types)
    own = table.join(wanted, ["stratum", "target"]).selectExpr("stratum", "target", *(f"x{i} * m{i} as x{i}" for i in range(len(terms))), "n", "y")
    patterns = own.groupBy("stratum", "target", *x).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    varied = patterns.where("y > 0 and y < n")
    apart = varied.unpivot(varied.columns, x, "term", "a").where("a <> 0")
    spans = {(r["stratum"], r["target"], r["term"]): r for r in apart.groupBy("stratum", "target", "term").agg(*(F.expr(f"sum(a * {name}) as h{name}") for name in x)).collect()}
    held: dict[tuple[str, str], np.ndarray] = {}
    for fit in fits:
        names = [f"x{terms.index(term)}" for term in fit.terms]
        rows = [spans.get((fit.stratum, fit.target, name)) for name in names]
        span = np.array([[float(row[f"h{name}"]) if row else 0.0 for name in names] for row in rows]).reshape(len(names), len(names))
        if names and np.linalg.matrix_rank(_scaled(span), tol=1e-11) < len(names):
            held[fit.stratum, fit.target] = span
    if not held:
        return {}
    keys = local_frame(table.sparkSession, {"stratum": [k[0] for k in held], "target": [k[1] for k in held]}, {"stratum": pa.string(), "target": pa.string()})
    sided: dict[tuple[str, str], list] = {key: [] for key in held}
    for row in patterns.where("n > 0 and (y = 0 or y = n)").join(keys, ["stratum", "target"], "left_semi").collect():
        sided[row["stratum"], row["target"]].append(row)
    found = {}
    for fit in fits:
        if (key := (fit.stratum, fit.target)) in held:
            names = [f"x{terms.index(term)}" for term in fit.terms]
            rows = np.array([[float(row[name]) for name in names] for row in sided[key]]).reshape(-1, len(names))
            made = limit(held[key], rows, np.array([1.0 if row["y"] else -1.0 for row in sided[key]]))
            if made.decided or len(made.free) < len(names):
                found[key] = made
    return found


def fit_all(table: DataFrame, terms: Sequence[str], fits: list[Fit]) -> list[Fit]:
    """Runs the fits over a pattern table (see ``by_outcome``) that is already stored.

    ``table`` is read once per step, so it should be a stored
    table. Only fits still moving take part in the next step.
    """
    limits = _limits(table, terms, fits)
    for fit in fits:
        fit.start(limits.get((fit.stratum, fit.target)))
    for _ in range(MOST_STEPS):
        moving = [fit for fit in fits if fit.status == "running"]
        if not moving:
            break
        found = {(row["stratum"], row["target"], row["term"]): row for row in _sums(table, terms, moving).collect()}
        for fit in moving:
            names = [f"x{terms.index(term)}" for term in fit.terms]
            rows = [found.get((fit.stratum, fit.target, name)) for name in names]
            if not any(rows):
                fit.status = "empty"
                continue
            fit.n = max(row["n"] for row in rows if row)
            information = np.array([[row[f"h{name}"] if row else 0.0 for name in names] for row in rows])
            fit.advance(information, np.array([row["score"] if row else 0.0 for row in rows]))
    for fit in fits:
        if fit.status == "running":
            fit.status = "not_converged"
    return fits


ODDS_SCHEMA = (
    "stratum string, target string, term string, beta double, se double, "
    "or_ double, lo double, hi double, n bigint, status string"
)


def odds_ratios(spark: SparkSession, fits: Sequence[Fit], level: float = 0.95) -> DataFrame:
    """Odds ratios with their interval, one row per fit and term; NULL where a fit has none.

    A term at infinity has odds ratio 0 or infinity and the interval from 0 to infinity; one that may go
    either way has none. A fit without any term keeps one row that shows its status.
    """
    z = normal_quantile(1 - (1 - level) / 2)
    rows = []
    for fit in fits:
        for i, term in enumerate(fit.terms or [None]):
            values = [None] * 5
            infinite = 0 if term is None or fit.status not in ("ok", "separated") else fit.infinite[i]
            if infinite in (-1, 1):
                values = [float(infinite) * math.inf, math.inf, math.inf if infinite > 0 else 0.0, 0.0, math.inf]
            elif term is not None and infinite == 0 and not np.isnan(fit.error[i]):
                beta, error = fit.beta[i], fit.error[i]
                values = [float(v) for v in (beta, error, *np.exp([beta, beta - z * error, beta + z * error]))]
            rows.append((fit.stratum, fit.target, term, *values, fit.n, fit.status))
    return spark.createDataFrame(rows, ODDS_SCHEMA)


def fitted_totals(table: DataFrame, terms: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    """``stratum, target, term, observed, fitted``: events with the term, seen and predicted.

    At the maximum of the likelihood both are equal for every term of a fit.
    """
    k = range(len(terms))
    sums = [f"sum(x{i} * y) as seen{i}" for i in k] + [f"sum(x{i} * n * p) as made{i}" for i in k]
    totals = _with_fit(table, terms, fits).groupBy("stratum", "target").agg(*(F.expr(text) for text in sums))
    entries = [
        F.struct(F.lit(t).alias("term"), F.col(f"seen{i}").alias("observed"), F.col(f"made{i}").alias("fitted"))
        for i, t in enumerate(terms)
    ]
    columns = {
        "stratum": [f.stratum for f in fits for _ in f.terms],
        "target": [f.target for f in fits for _ in f.terms],
        "term": [t for f in fits for t in f.terms],
    }
    wanted = local_frame(table.sparkSession, columns, dict.fromkeys(columns, pa.string()))
    stacked = totals.select("stratum", "target", F.inline(F.array(*entries)))
    return stacked.join(wanted, ["stratum", "target", "term"])
