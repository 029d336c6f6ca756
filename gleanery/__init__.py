"""Record consolidation on Spark: normalise, merge, select, track and publish records as DataFrame jobs."""
