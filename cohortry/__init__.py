"""Cohort analytics as Spark DataFrame operators.

``sources``    readers, writers, code lists, resumable stages
``functions``  column expressions: names, age bands, intervals, odds ratios
``operators``  DataFrame in, DataFrame out
``plans``      the cohort build and the reports made from it
"""
