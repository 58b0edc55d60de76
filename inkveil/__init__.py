"""Finding and redacting sensitive data in large document collections, on Spark."""
