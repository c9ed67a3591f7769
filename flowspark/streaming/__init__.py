"""flowspark.streaming."""
