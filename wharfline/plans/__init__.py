"""Plans: whole runs and the query catalogue over the driver's tables."""
