"""Query catalogue: each module has QUERIES and ORACLES."""
