"""Training-data operators: cleaning, deduplication, scoring, mixing and tokenising of document corpora.

Each module holds one operator over DataFrames. ``ledgerloom.llm.queries`` registers the ``opN_<name>`` queries.
Nothing outside this package imports it.
"""
