"""Training-data operators: language ID, near-dedup, filters, mixing, scoring.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; `registry` lists the thin driver queries built on them.
"""
