"""gramforge: indexed text search and corpus operators on PySpark."""
