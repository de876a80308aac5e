"""Analytics of token calls, pool events and transfer ledgers as Spark jobs."""
