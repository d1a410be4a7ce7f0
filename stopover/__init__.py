"""Location and conversation analytics as Spark DataFrame plans."""
