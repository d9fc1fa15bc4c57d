"""marginalia: a PySpark-native retrieval, evaluation and corpus engine.

Everything is a function from DataFrames to DataFrames; Catalyst picks the
physical plan. Sub-packages: ``functions`` (column expressions), ``operators``
(DataFrame operators), ``sources`` (scans and sinks), ``plans`` (composed
queries and plan helpers), ``streaming`` (stateful operators).
"""
