"""Discrete event sequences as per-key, time-ordered trails, on Spark DataFrames."""
