"""Frame-table analytics on PySpark."""
