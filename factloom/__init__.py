"""Text veracity analytics on PySpark."""
