"""presswire: news-source analytics on Spark DataFrames."""
