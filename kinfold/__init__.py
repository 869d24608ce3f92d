"""kinfold - embedding-based family discovery and scoring as Spark jobs."""
