"""Training-data operators: deduplication, sharding, scoring, packing and mixing as Spark jobs.

Nothing else in the library imports this package.  Each operator lives in a module of its own
with a general interface; ``queries.py`` applies them to the tables with production parameters.
"""
