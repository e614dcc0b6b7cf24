"""Clinical-history analytics expressed as Spark DataFrame operators."""
