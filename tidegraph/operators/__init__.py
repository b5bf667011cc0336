"""Graph operators over the operation log and the graph tables."""
