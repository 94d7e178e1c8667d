"""scanloom: a Spark-first engine for inspecting 3-D surface scans stored as DataFrames."""

__version__ = "0.1.0"
