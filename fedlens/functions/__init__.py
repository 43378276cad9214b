"""Column-level building blocks: seeded hashing, array maths, report text."""
