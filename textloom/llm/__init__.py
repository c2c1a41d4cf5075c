"""Training-data operators: dedup, scoring, archiving, tokenising, sanitising, packing.

Nothing outside this package imports it; ``queries.py`` registers the operators.
"""
