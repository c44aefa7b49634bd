"""Training-data operators: URL filtering, search, dedup, packing, extraction, mixing,
archives and quality scoring, each a Spark job over whole tables."""
