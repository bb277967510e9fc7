"""lumenframe: a Spark-first analytics engine for media, text and event data."""
