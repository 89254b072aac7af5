"""Multi-aspect product-review analytics as Spark DataFrame operators."""
