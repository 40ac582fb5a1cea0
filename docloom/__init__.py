"""Document analytics as Spark DataFrame operators."""
