"""Training-data operators (deduplication, cleaning, tokenising) on Spark DataFrames.

Nothing outside this folder imports it; ``queries.py`` holds the entries that
``__spark_entry__`` registers.
"""
