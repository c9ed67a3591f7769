"""flowspark.plans."""
