"""A documentation search and corpus preparation engine on Spark."""
