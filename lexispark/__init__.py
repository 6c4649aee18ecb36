"""lexispark: corpus analytics as Spark jobs (text, vectors, event logs)."""
