"""Cohort analytics on Spark DataFrames: sets at a grain, time lines, rules, reviews, releases."""
