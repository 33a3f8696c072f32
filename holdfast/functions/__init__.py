"""Column expressions: names, paths, sizes, hashes."""
