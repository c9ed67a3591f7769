"""flowspark.functions."""
