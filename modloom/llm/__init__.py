"""Operators for large-scale training-data pipelines. Nothing else in modloom imports this package."""
