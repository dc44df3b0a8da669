"""Contact records from landed news-release pages, on Spark."""
