"""Event, place and conditions analytics as Spark DataFrame operators."""
