"""Training-data operators: scoring, near-duplicates, extraction, mixing, packing.

Nothing outside this package imports it; ``probelake.llm.queries`` holds the
registered queries and their SQL.
"""
