"""Training-data operators: search, filtering, tokenising, de-duplication, extraction and archiving.

Nothing outside this subpackage imports it. ``queries`` registers one query for each operator.
"""
