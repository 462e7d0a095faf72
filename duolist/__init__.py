"""Two-member list recommendation and corpus preparation on Spark."""
