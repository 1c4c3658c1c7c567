"""Market-price panel analytics as PySpark DataFrame operators."""
