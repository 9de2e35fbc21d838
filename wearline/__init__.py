"""Fleet health analytics as Spark DataFrame operators."""
