"""Column functions: canonical keys, typed values, dates, hashes."""
