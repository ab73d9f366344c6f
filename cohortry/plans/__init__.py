"""The cohort build and the reports made from it."""
