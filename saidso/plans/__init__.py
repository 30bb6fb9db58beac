"""Jobs composed from operators, and the named queries on the driver tables."""
