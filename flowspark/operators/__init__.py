"""flowspark.operators."""
