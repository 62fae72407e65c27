"""Market-snapshot replay, trade analytics and data-quality operators on PySpark."""
