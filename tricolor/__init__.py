"""tricolor: tabular binary classification as Spark jobs.

Load a table, number its rows, profile it, fill missing values, map a two-valued
target, one-hot encode, split, scale, derive features, drop outliers, rebalance,
reduce dimensions, fit and tune classifiers, and score new tables with metrics,
probabilities and green / yellow / red confidence labels.

Every data step is a DataFrame expression or a ``pyspark.ml`` estimator; every random
choice is derived from an md5 hash so the relational results can be checked in SQL.
"""

__version__ = "0.1.0"
