"""Evidence verification as Spark DataFrame transforms."""
