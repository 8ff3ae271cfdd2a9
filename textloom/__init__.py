"""textloom: Spark-first building, auditing and evaluating of text corpora."""
