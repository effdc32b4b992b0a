"""shopstar: a retail data warehouse (ingest, staging, star-schema marts,
reports, table operations, metric expressions) as Spark DataFrame jobs.

Packages: ``sources`` (files and tables in), ``operators`` (layer builders,
layout, table operations, time series), ``functions`` (column helpers),
``plans`` (the reports and their oracle SQL), ``llm`` (operators of a
training-data pipeline; optional).  Entry points: ``__spark_entry__.py``, ``python -m shopstar``.
"""
