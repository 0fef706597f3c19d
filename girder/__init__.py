"""girder: a Spark-first analytics engine for building-model element tables."""
