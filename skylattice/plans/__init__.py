"""End-to-end plans, and the queries that exercise every operator on plain tables."""
