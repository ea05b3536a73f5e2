"""Document retrieval, evaluation and corpus processing as PySpark DataFrame operators."""
