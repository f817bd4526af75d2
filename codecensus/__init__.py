"""codecensus: analytics over source-code corpora and the runs that work on them, on PySpark.

Every operator takes DataFrames and returns a DataFrame.  Jobs run while a plan is being built
only in the writers of :mod:`codecensus.sources` and where a result is cut off from its lineage
by :func:`codecensus.functions.scale.durable`.
"""

__version__ = "0.1.0"
