"""certus: Spark jobs that measure how far a language model's YES/NO answers can be trusted."""
