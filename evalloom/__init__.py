"""Study-level evaluation as Spark DataFrame operators."""
