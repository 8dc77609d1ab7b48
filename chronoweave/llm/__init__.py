"""Training-data operators: classification, mixing, privacy, licences, deduplication, encoding, scoring.

Every module holds one operator with its own general interface, and the thin
``opN_<name>`` query that derives the registered columns from it.
``registry`` lists the queries; ``__spark_entry__`` adds them if this package is present.
"""
