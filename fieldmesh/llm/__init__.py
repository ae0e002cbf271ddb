"""Operators of a training-data pipeline: deduplication, classifiers, scoring, tokenizing, scans.

Nothing else in ``fieldmesh`` imports this subpackage.
"""
