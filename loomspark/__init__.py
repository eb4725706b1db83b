"""loomspark: temporal and machine-learning data operators as Spark jobs."""
