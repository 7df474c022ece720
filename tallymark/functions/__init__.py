"""Column expressions: no data moves here, everything is lazy."""
