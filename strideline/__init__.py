"""Walk-forward analytics on Spark."""
