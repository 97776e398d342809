"""Registered queries over the given tables, the stub model they use, and their SQL twins."""
