"""Lorefield: document-retrieval and conversation analytics as Spark jobs."""
