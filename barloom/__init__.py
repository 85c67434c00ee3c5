"""Bar-oriented time-series research on Apache Spark."""
