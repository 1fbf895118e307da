"""Marketing and commerce analytics on Spark: cleaning, marts, reports and exports."""
