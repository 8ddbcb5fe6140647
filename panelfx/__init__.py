"""Panel causal inference on Spark."""
