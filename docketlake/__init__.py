"""docketlake: court documents as DataFrames.

Parsing, extraction, segmentation, identity, quality gates and search for court
judgments, written as Spark column expressions and DataFrame operators.
"""
