"""Reading the given tables, deriving the weekly feeds, reading and writing feed files."""
