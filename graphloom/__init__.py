"""graphloom: ontology-grounded data constraints as plain Spark DataFrames."""

__version__ = "0.1.0"
