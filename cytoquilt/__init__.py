"""Spark-native operators for single-cell cohorts kept as tables.

Every operator is a plain function from DataFrame(s) to DataFrame. Counts are
kept long and sparse (one row per non-zero cell/gene pair), cells and genes are
ordinary tables, and Catalyst does the planning.
"""

__version__ = "0.1.0"
