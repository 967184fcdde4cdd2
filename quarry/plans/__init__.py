"""How plans are run: stage tables and partitioning."""
