"""Customer analytics for marketplace data, expressed as Spark DataFrame operators."""
