"""corpusmill: corpus evaluation and data preparation as Spark DataFrame jobs."""
