"""Analytics of learning records, content quality and ledgers on Spark."""
