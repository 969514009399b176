"""Text-corpus analytics on Spark: gates, features, de-duplication, balancing, packing, pairs, web pages, leaderboards."""
