"""Parts-inventory analytics on Spark."""
