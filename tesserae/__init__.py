"""Document analytics and retrieval on PySpark: every operator is a lazy DataFrame transformation."""
