"""Training-data operators: tokenising, language ID, deduplication, joins, scans and extraction.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
