"""Spark-native record linkage and corpus engine.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (joins, top-k, metrics, graph), ``plans`` (end-to-end queries) and
``streaming`` (micro-batch linkage).
"""

__version__ = "0.1.0"
