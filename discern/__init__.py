"""discern: classification analytics on Spark DataFrames.

Load, clean, split, featurise, train, tune and evaluate classifiers with the
DataFrame, SQL and ``pyspark.ml`` APIs.  Sub-packages:

``sources``    tables, wide CSV, LIBSVM, split hand-off, shared scratch tables
``functions``  column expressions (hashing, letters, tokens, ratios)
``operators``  DataFrame-to-DataFrame operators, classifiers, tuning, metrics
``plans``      whole jobs, and the registered queries with their SQL
``streaming``  scoring of a stream with a fitted model
"""

__version__ = "0.1.0"
