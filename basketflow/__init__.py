"""basketflow: a retail data pipeline on Spark.

Layers: ``sources`` (documents, imports, exports, the driver-table lens),
``functions`` (Column helpers), ``operators`` (DataFrame → DataFrame jobs),
``plans`` (table resolution, the query catalog, end-to-end jobs) and
``streaming`` (Structured Streaming ingest and the stateful alert rule).
"""

__version__ = "0.1.0"
