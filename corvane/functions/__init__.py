"""Column functions; Python only where Spark SQL has no equivalent."""
