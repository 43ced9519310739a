"""A Spark-first engine for fact relations: retrieval, graph walks, evidence folding, reports and streams."""
