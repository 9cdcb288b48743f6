"""Readers and sinks; every path goes through Spark's own file systems."""
