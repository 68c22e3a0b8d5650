"""Spark-native aggregation of structural-variant calls and the data preparation around it.

Every operator is a function from DataFrames to a DataFrame.  ``callweave.plans.merge`` composes them into
the full merge of many call sets; ``callweave.plans.registry`` lists the queries with their SQL twins.
"""

__version__ = "0.1.0"
