"""Point-in-time market analytics expressed as Spark DataFrame jobs."""
