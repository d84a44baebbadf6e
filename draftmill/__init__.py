"""Analytics for schematic drawings and their annotations, as Spark DataFrame operators."""
