"""Object-sync analytics as Spark DataFrame operators."""
