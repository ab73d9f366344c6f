from __future__ import annotations

from cohortry.operators import logtimes

LINES = [
    "2020-01-01 10:00:00,001 - base.m - INFO - Starting the function [f] ...",
    "2020-01-01 10:00:01,001 - base.m - INFO - Finished the function [f] in 1.000000e+00 seconds",
    "2020-01-01 10:00:04,001 - base.m - INFO - Finished the function [f] in 3.000000e+00 seconds",
    "2020-01-01 10:00:05,001 - base.m - INFO - Finished the function [g] in 5.000000e-01 seconds",
    "2020-01-01 10:00:05,002 - base.m - ERROR - Unable to read the file",
    "2020-01-01 10:00:06,001 - base.m - INFO - Finished the main program in 6.000000e+00 seconds",
]


def lines_of(spark):
    return spark.createDataFrame([(line,) for line in LINES], "value string")


def test_marks(spark):
    lines = lines_of(spark)
    assert [r["value"] for r in logtimes.error_lines(lines).collect()] == [LINES[4]]
    assert logtimes.timing_lines(lines).count() == 4
    assert {r["level"] for r in logtimes.parsed(lines).collect()} == {"INFO", "ERROR"}


def test_times(spark):
    times = logtimes.function_times(lines_of(spark))
    found = {r["fn"]: (r["n"], r["total"], r["average"]) for r in times.collect()}
    assert found == {"[f]": (2, 4.0, 2.0), "[g]": (1, 0.5, 0.5)}
    bars = {r["fn"]: (r["steps"], r["bar"]) for r in logtimes.with_bars(times).collect()}
    assert bars["[f]"] == (30, logtimes.BAR_MARK * 30)
    assert bars["[g]"] == (7, logtimes.BAR_MARK * 7 + " " * 23)
    text = sorted(r["line"] for r in logtimes.report_lines(times).collect())
    assert text[0] == f"{'[f]':>40} {2:>10} {4.0:>7.2f} {2.0:>10.2e} [{logtimes.BAR_MARK * 30}]"
