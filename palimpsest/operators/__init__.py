"""Operators over whole tables: numbering, documents, pairing, metrics, text statistics."""
