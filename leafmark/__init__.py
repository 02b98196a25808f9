"""Page-layout text analytics as Spark DataFrame operators."""
