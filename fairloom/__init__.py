"""fairloom: a Spark-first analytics engine for trade-fair data and training-data corpora."""
