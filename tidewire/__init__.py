"""News-intelligence analytics as Spark DataFrame plans."""
