"""Order-dependent greedy operators: one bounded group at a time in pandas, groups spread by Spark."""
