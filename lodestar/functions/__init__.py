"""Part of lodestar, a similarity-identification engine on Spark."""
