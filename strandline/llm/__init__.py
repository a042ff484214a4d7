"""Operators for training-data pipelines: dedup, scans, packing, formatting, rules, mixing.

Nothing outside this package imports it.
"""
