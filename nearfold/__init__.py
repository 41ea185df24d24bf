"""nearfold: near-duplicate analytics over file and text collections on Spark DataFrames."""

__version__ = "0.1.0"
