"""Property-graph analytics and corpus building on Spark."""
