"""Point clouds and training data at scale, on Spark."""
