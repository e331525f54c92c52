"""Knowledge-corpus engine written as PySpark DataFrame and streaming operators."""
