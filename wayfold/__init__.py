"""Points of interest, road networks and movement streams as Spark jobs."""
