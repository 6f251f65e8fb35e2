"""webloom: crawl frontiers, structured extraction and training-data operators on Spark."""
