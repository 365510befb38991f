"""Statistical process control on Spark: every manufacturing context in one grouped job."""
