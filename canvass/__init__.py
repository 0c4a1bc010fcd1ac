"""Survey and population-simulation analytics on Spark."""
