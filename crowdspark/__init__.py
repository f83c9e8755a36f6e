"""Spark-native crowd analytics: queue readings -> daily crowd level -> features -> forest.

Sub-packages
------------
sources    readers / writers for the landed tables (readings, park dims, holidays,
           schedules, weather, forecast and chart payloads)
functions  column-expression helpers (calendar, rounding, wall-clock, parsing)
operators  DataFrame -> DataFrame building blocks (labels, features, alignment,
           imputation, encoding, model, report)
plans      composed training / inference frames and the registered queries
streaming  Structured Streaming ingest of raw readings
"""

__version__ = "0.1.0"
