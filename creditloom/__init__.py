"""Credit batch, reconciliation, code-estate and run-quality jobs on Spark."""
