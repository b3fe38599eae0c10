"""Structured Streaming operators: settling association, live clock links, track lifecycles, rates."""
