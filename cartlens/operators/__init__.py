"""Relational building blocks Spark does not offer as one call, built from its own operators."""
