"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general interface;
``claimgraph.llm.entry`` registers the thin queries built on them.
"""
