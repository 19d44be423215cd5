"""Continuous-training analytics as plain PySpark DataFrame functions."""
