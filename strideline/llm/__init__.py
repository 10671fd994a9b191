"""Training-data operators: extraction, scoring, filtering, de-duplication and packing of documents.

Nothing else in the library imports this package; ``queries.py`` here registers its queries.
"""
