"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; the folder can be removed as a whole.
"""
