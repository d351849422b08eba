"""Operators for preparing training text and embeddings at corpus scale.

Nothing else in the package imports this subpackage. Every operator takes DataFrames and
returns one; intermediate tables go below ``spark.checkpoint.dir`` so that a lost executor
never loses them.
"""
