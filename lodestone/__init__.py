"""Text analytics and retrieval on PySpark: chunk, index, search, compact and measure whole corpora."""
