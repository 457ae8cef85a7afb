"""Set-based reading analytics over many paged documents, on PySpark."""
