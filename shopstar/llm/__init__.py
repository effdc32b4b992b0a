"""Operators of a training-data pipeline on Spark.

Ten operators over ``documents``, ``pages`` and ``embeddings``; one module
each, all stateless functions of DataFrames.  ``queries.py`` holds the thin
registered queries (``opN_<name>``) that derive the contracted columns from
the operators' own outputs, and the DuckDB SQL where SQL can state them.

Functions that run in Python workers are pickled by value, so executors need
the third-party libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
