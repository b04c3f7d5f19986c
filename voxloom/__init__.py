"""voxloom: a Spark-first engine for transcript history, text and stream data."""
