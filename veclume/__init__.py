"""Vector analytics on PySpark."""
