"""Operators of a training-data pipeline over a corpus of documents.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
