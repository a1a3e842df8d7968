"""kerbside: driving-scene analytics written as Spark DataFrame jobs."""
