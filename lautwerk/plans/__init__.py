"""Driver-side parsers of queries and rules, and their compilation to expressions."""
