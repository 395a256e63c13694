"""Training-data operators: packing, sharding, deduplication, classifiers, decontamination.

Each module holds one operator with its general interface, and the thin ``opN_<name>`` query that
applies it to the ``documents`` table of a folder of Parquet tables. :mod:`siteloom.llm.registry`
lists the queries.
"""
