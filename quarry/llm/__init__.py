"""Training-data operators: deduplication, filtering, formatting and tokenising of text corpora.

Each module holds one operator family with a general DataFrame interface; ``queries`` holds the registered queries.
Nothing else in the library imports this subpackage.
"""
