"""plumbline: inspection analytics as Spark DataFrame operators."""
