"""SPARQL text to an algebra, and rewrites on it."""
