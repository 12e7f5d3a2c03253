"""Readers and writers: corpora, result tables, predictions, run configurations."""
