"""Analytics for evaluation runs of search-and-answer agents, as Spark DataFrame jobs."""
