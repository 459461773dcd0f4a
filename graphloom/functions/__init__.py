"""Column functions: numeric, seeded randomness, integer partitions."""
