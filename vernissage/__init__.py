"""Weak-label auditing for catalog records, written as Spark DataFrame jobs."""
