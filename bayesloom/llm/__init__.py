"""Training-data operators for very large text corpora.

Nothing outside this package imports it; ``queries.py`` lists its queries for the driver's entry file.
"""
