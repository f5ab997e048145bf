"""Daily-price analytics as PySpark DataFrame operators."""
