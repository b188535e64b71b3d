"""Text inspection, routing and evaluation as Spark DataFrame operators."""
