"""Graph link-prediction analytics as PySpark DataFrame operators."""
