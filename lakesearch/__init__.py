"""Document search, evidence and relevance analytics as Spark DataFrame operators."""
