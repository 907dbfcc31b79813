"""depweft: a Spark-first engine for dependency graphs, change analytics and corpus preparation."""

__version__ = "0.1.0"
