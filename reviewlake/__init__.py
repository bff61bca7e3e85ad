"""Code-review analytics as Spark DataFrame queries."""
