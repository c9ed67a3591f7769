"""flowspark.sources."""
