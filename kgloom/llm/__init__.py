"""Operators for the records, scores, vectors and texts of large training-data pipelines."""
