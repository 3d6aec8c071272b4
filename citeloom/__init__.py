"""Evidence-grounded retrieval, packaging and evaluation as Spark DataFrame jobs."""
