"""Land-register analytics as Spark DataFrame operators."""
