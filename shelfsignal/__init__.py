"""Retail signals on Spark."""
