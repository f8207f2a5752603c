"""tablelore: profile, explain and document lakehouse tables with Spark DataFrames."""

__version__ = "0.1.0"
