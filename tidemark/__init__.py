"""tidemark: replay-safe incremental analytics expressed as Spark DataFrame plans."""
