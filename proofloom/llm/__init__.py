"""Operators for training-data pipelines: ten methods over documents, pages and vectors.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; where a step runs on Arrow batches, it looks at one row at a time
or at one bounded batch, and Spark partitions and shuffles the work.
"""
