"""Operators on DataFrames: hierarchy, resolution, classification, quality, imports, matching, decisions."""
