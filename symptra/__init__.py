"""Survey-based symptom surveillance analytics as Spark DataFrame operators."""
