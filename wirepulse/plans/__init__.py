"""End-to-end plans that chain operators: ingest cycle, story job, retention."""
