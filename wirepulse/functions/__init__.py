"""Column-level building blocks: scoring, text cleaning, time grid, geography, embeddings."""
