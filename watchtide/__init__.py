"""Security-log analytics as Spark DataFrame transformations."""
