"""Transcript-archive analytics and corpus operators on Spark."""
