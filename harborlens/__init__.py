"""Company, people and news monitoring as Spark DataFrame jobs."""
