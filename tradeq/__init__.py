"""Trade-data quality and route analytics as PySpark DataFrame functions."""
