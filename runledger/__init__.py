"""Job-accounting analytics as PySpark DataFrame jobs."""
