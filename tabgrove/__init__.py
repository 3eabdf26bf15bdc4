"""Tabular classification on Spark: clean, index, assemble, tune a forest, score, evaluate."""
