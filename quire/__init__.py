"""Transcript analytics and corpus preparation as Spark DataFrame transforms."""
