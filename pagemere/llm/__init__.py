"""Training-data operators: scoring, near-duplicates, decontamination, packing, media, archives.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the registered queries.
"""
