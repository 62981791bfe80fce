"""Column functions: keys, text, sketches' hashing."""
