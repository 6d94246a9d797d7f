"""Operators over DataFrames: layout, segmentation, matching, auditing, reporting."""
