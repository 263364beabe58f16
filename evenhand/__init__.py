"""Outcome-balance audits of two-sided trials, written as Spark DataFrame jobs."""
