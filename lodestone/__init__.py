"""Document retrieval analytics as DataFrame pipelines."""
