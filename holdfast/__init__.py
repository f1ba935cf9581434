"""Subscriber-retention analytics as lazy Spark DataFrames."""
