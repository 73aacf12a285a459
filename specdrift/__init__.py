"""specdrift: documentation-drift analytics expressed as Spark DataFrame operators."""
