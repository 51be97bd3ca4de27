"""Training-data operators: deduplication, packing, filtering, classification, search and tokenising.

Nothing else in the package imports from here; ``vellum.llm.queries`` registers one
query per operator.
"""
