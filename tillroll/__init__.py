"""tillroll: receipt cleaning, hierarchical imputation and profiling on Spark.

Every operator is a pure ``DataFrame -> DataFrame`` function built from the
DataFrame / SQL API, so Catalyst plans it and executors do all row work.
"""

__version__ = "0.1.0"
