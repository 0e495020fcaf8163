"""Choose which items of a test set are worth annotating, on Spark."""
