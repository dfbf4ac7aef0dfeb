"""Transcript search and evaluation jobs on Spark."""
