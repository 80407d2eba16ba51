"""Evidence analytics on Spark: ingest, retrieval, grounding, evaluation and reporting over tables."""
