"""The engine that screens requests, the checks built on it, and the catalogue of queries."""
