"""Training-data operators: joins, deduplication, filters, models and file formats for text corpora.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query per operator.
"""
