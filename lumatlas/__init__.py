"""Photo-location analytics as PySpark DataFrame operators."""
