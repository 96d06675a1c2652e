"""folioflow: document preparation, layout and quality analytics as Spark jobs."""
