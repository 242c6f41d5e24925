"""Transaction-risk analytics expressed as Spark DataFrame, MLlib and streaming jobs."""
