"""Network-reconnaissance analytics expressed as Spark DataFrame operators."""
