"""Knowledge-base analytics as Spark DataFrame operators."""
