"""ravelin: specification, requirement and program-graph analytics on PySpark.

Every operator is a function from DataFrames to a DataFrame.  ``operators``
holds the operators, ``sources`` readers and writers, ``functions`` scalar
column functions, ``plans`` the query registry, ``streaming`` the live
operators and ``llm`` the training-text operators (nothing imports ``llm``).
"""

__version__ = "0.1.0"
