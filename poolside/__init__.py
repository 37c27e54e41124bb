"""Competition-results analytics and text-corpus preparation on Spark."""
