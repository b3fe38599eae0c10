"""Column functions: geometry, frame decoding, statistics, identifiers."""
