"""Spark-native analytics for corpora of source functions and the experiments that transform them.

``functions``  column expressions (no I/O, no shuffles)
``sources``    readers, the model catalogue, writers
``operators``  DataFrame -> DataFrame building blocks
``plans``      the registered queries, bound to concrete tables
``streaming``  Structured Streaming aggregates and upserts
"""
