"""Water-quality column standardisation and measurement analytics on PySpark."""
